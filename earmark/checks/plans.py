"""Registered queries for the test plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.checks.matching_sql import P
from earmark.checks.support import Query, r6, tidy
from earmark.plans import variants as T

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            ORACLES[name] = P.sql(sql)
        return fn

    return wrap


_LONG = "a long description that makes the rendered id of this variant so long that it is cut at two hundred characters and ends in a digest, whatever the name of the track may be"
MATRIX = {
    "speed_change": {"enabled": True, "parameters": [{"speed": 0.97, "preserve_pitch": False, "severity": "mild"}, {"speed": 1.1, "preserve_pitch": False, "severity": "severe"}]},
    "time_stretch": {"enabled": True, "parameters": [{"ratio": 1.05}]},
    "low_pass_filter": {"enabled": True, "parameters": [{"freq_hz": 200, "description": "bass-only", "severity": "severe"}, {"freq_hz": 6000}]},
    "overlay_vocals": {"enabled": True, "parameters": [{"overlay_path": "vox/a:b.wav", "level_db": -6.0}, {"overlay_path": None, "level_db": -3.0}]},
    "add_noise": {"enabled": True, "parameters": [{"snr_db": 20, "noise_type": "white", "severity": "mild", "description": _LONG}]},
    "re_encode": {"enabled": False, "parameters": [{"codec": "mp3"}]},
    "combine_chain": {
        "enabled": True,
        "chains": [
            {"name": "faster", "severity": "moderate", "transforms": [{"type": "speed_change", "params": {"speed": 1.03}}, {"type": "gain", "params": {"db": -3}}]},
            {"name": "quiet", "transforms": [{"type": "gain", "params": {"db": -12}}]},
        ],
    },
}


def _tracks(spark, sf):
    return X.table(spark, sf, "documents").select(F.concat(F.lit("track"), F.col("doc_id").cast("string")).alias("id"))


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _safe(text: str | None) -> str:
    return "None" if text is None else "".join("_" if c in '/\\:*?"<>|' else c for c in text)


def _entry_rows() -> str:
    rows = []
    for e in T.matrix_entries(MATRIX):
        rendered = "_".join(f"{k}_{_safe(v)}" for k, v in sorted(e["id_params"].items()))
        named = T.RENAMES.get(e["transform_type"], {})
        final = {named.get(k, k): v for k, v in e["params"].items() if not (k in named and v is None)}
        listed = "|".join(f"{k}={v}" for k, v in sorted(final.items()))
        rows.append(f"({_quote(e['transform_type'])}, {_quote(e['transform_name'])}, {_quote(e['severity'])}, {_quote(rendered)}, {_quote(listed)})")
    return ", ".join(rows)


P.add("matrix", f"SELECT * FROM (VALUES {_entry_rows()}) t(transform_type, transform_name, severity, rendered, final_params)")
P.add(
    "planned",
    "SELECT orig_id, transform_type, transform_name, severity, final_params, CASE WHEN length(f) > 200 THEN substr(f, 1, 191) || '_' || substr(md5(f), 1, 8) ELSE f END AS transformed_id FROM ("
    "SELECT 'track' || d.doc_id AS orig_id, m.*, 'track' || d.doc_id || '__' || transform_type || '__' || rendered AS f FROM documents d, matrix m)",
)


@register("expand_matrix", "SELECT orig_id, transform_type, transform_name, severity, transformed_id FROM planned")
def expand_matrix(spark, sf):
    return T.expand_matrix(_tracks(spark, sf), MATRIX).select("orig_id", "transform_type", "transform_name", "severity", "transformed_id")


@register("variant_id", "SELECT transformed_id, length(transformed_id) AS length FROM planned")
def variant_ids(spark, sf):
    return T.expand_matrix(_tracks(spark, sf), MATRIX).select("transformed_id", F.length("transformed_id").alias("length"))


_steps = ", ".join(
    f"({_quote(c['name'])}, {_quote(c['severity'])}, {i}, {_quote(s['type'])}, {_quote('|'.join(f'{k}={v}' for k, v in sorted(s['params'].items())))})"
    for c in T.matrix_chains(MATRIX)
    for i, s in enumerate(c["steps"])
)


@register(
    "expand_chains",
    "SELECT 'track' || doc_id AS orig_id, 'track' || doc_id || '__chain_' || name || '__severity_' || severity AS transformed_id, 'combine_chain' AS transform_type, name AS transform_name, severity, step, step_type, params "
    f"FROM documents, (VALUES {_steps}) c(name, severity, step, step_type, params)",
)
def expand_chains(spark, sf):
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return T.expand_chains(_tracks(spark, sf), MATRIX).withColumn("params", listed)


P.add("done", "SELECT transformed_id FROM planned WHERE substr(md5(transformed_id), 1, 1) IN ('0', '1', '2', '3')")


def _plan_and_done(spark, sf):
    planned = T.expand_matrix(_tracks(spark, sf), MATRIX)
    return planned, planned.where(F.substring(F.md5(F.col("transformed_id").cast("binary")), 1, 1).isin("0", "1", "2", "3")).select("transformed_id")


@register("pending_variants", "SELECT orig_id, transformed_id FROM planned WHERE transformed_id NOT IN (SELECT transformed_id FROM done)")
def pending_variants(spark, sf):
    return T.pending_variants(*_plan_and_done(spark, sf)).select("orig_id", "transformed_id")


@register("variant_record", "SELECT transformed_id, transformed_id IN (SELECT transformed_id FROM done) AS made FROM planned")
def variant_record(spark, sf):
    return T.variant_record(*_plan_and_done(spark, sf)).select("transformed_id", "made")


@register("param_rename", "SELECT transformed_id, final_params AS params FROM planned")
def param_rename(spark, sf):
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return T.param_rename(T.expand_matrix(_tracks(spark, sf), MATRIX)).select("transformed_id", listed.alias("params"))


_overlay = (
    "CASE WHEN transform_type IN ('song_a_in_song_b', 'embedded_sample') THEN 'severe' WHEN transform_type = 'low_pass_filter' AND (lower(transformed_id) LIKE '%freq_hz_200%' OR lower(transformed_id) LIKE '%bass-only%') THEN 'severe' "
    "WHEN transform_type = 'low_pass_filter' THEN 'moderate' WHEN transform_type = 'overlay_vocals' THEN '{o}' ELSE 'mild' END"
)


@register("detect_severity", f"SELECT transformed_id, {_overlay.format(o='moderate')} AS detected, {_overlay.format(o='severe')} AS strict FROM planned")
def detect_severity(spark, sf):
    kind, path = F.col("transform_type"), F.col("transformed_id")
    return T.expand_matrix(_tracks(spark, sf), MATRIX).select(
        "transformed_id", T.detect_severity(kind, path).alias("detected"), T.detect_severity(kind, path, "strict").alias("strict")
    )


# Every event is a request with a transform, a severity and a confidence; some have neither.
_KINDS = {"view": "low_pass_filter", "click": "song_a_in_song_b", "error": "add_noise", "purchase": "embedded_sample"}
_kind = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_severity = "CASE event_id % 4 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' WHEN 2 THEN 'severe' END"
P.add("requests", f"SELECT event_id, {_kind} AS transform_type, {_severity} AS severity, value / 100 AS confidence FROM events")
P.add(
    "depths",
    "SELECT *, CAST(trunc(CASE transform_type WHEN 'low_pass_filter' THEN 80 WHEN 'song_a_in_song_b' THEN 100 WHEN 'embedded_sample' THEN 100 WHEN 'add_noise' THEN 40 ELSE 20 END "
    "* CASE severity WHEN 'severe' THEN 1.3::DOUBLE WHEN 'moderate' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) AS k0, coalesce(transform_type IN ('song_a_in_song_b', 'embedded_sample'), false) AS deep FROM requests",
)


def _requests(spark, sf):
    return X.table(spark, sf, "events").selectExpr("event_id", f"{_kind} AS transform_type", f"{_severity} AS severity", "value / 100 AS confidence")


@register(
    "adaptive_topk",
    "SELECT event_id, k0 AS k, CASE WHEN confidence > 0.9 AND NOT deep THEN greatest(10, CAST(trunc(k0 * 0.7::DOUBLE) AS BIGINT)) ELSE k0 END AS k_confident, "
    "CASE WHEN deep AND k0 * 6 > 600 THEN least(k0, greatest(220, CAST(trunc(k0 * 0.85::DOUBLE) AS BIGINT))) ELSE k0 END AS k_target, "
    "CASE transform_type WHEN 'low_pass_filter' THEN 35 WHEN 'song_a_in_song_b' THEN 20 WHEN 'embedded_sample' THEN 20 ELSE 30 END AS k_service FROM depths",
)
def adaptive_topk(spark, sf):
    kind, severity = F.col("transform_type"), F.col("severity")
    return _requests(spark, sf).select(
        "event_id",
        T.adaptive_topk(kind, severity).alias("k"),
        T.adaptive_topk(kind, severity, F.col("confidence")).alias("k_confident"),
        T.adaptive_topk(kind, severity, target_ms=600.0, ms_per_hit=6.0).alias("k_target"),
        T.service_topk(kind, severity).alias("k_service"),
    )


@register(
    "severity_adjust",
    f"SELECT event_id, {r6('CASE severity WHEN ' + chr(39) + 'moderate' + chr(39) + ' THEN greatest(0.22, confidence / 10) WHEN ' + chr(39) + 'severe' + chr(39) + ' THEN greatest(0.18, confidence / 10) ELSE confidence / 10 END')} AS threshold, "
    f"{r6('CASE severity WHEN ' + chr(39) + 'moderate' + chr(39) + ' THEN least(1.0, confidence + 0.15) WHEN ' + chr(39) + 'severe' + chr(39) + ' THEN least(1.0, confidence + 0.25) ELSE confidence END')} AS fusion_ratio, "
    f"{r6('CASE severity WHEN ' + chr(39) + 'moderate' + chr(39) + ' THEN least(0.25, confidence / 5 + 0.05) WHEN ' + chr(39) + 'severe' + chr(39) + ' THEN least(0.30, confidence / 5 + 0.08) ELSE confidence / 5 END')} AS temporal_weight FROM requests",
)
def severity_adjust(spark, sf):
    c = F.col("confidence")
    rows = _requests(spark, sf).select("event_id", "severity", (c / 10).alias("threshold"), c.alias("fusion_ratio"), (c / 5).alias("temporal_weight"))
    return T.severity_adjust(rows).drop("severity")


P.add("scales", "SELECT user_id AS query_id, event_type AS scale, CASE WHEN user_id % 5 = 0 AND event_type = 'view' THEN NULL ELSE sum(value) END AS weight FROM events GROUP BY user_id, event_type")


@register(
    "scale_weights",
    f"SELECT query_id, scale, {r6('CASE WHEN bool_or(weight IS NULL) OVER (PARTITION BY query_id) THEN 1.0 / count(*) OVER (PARTITION BY query_id) ELSE weight / sum(weight) OVER (PARTITION BY query_id) END')} AS weight FROM scales",
)
def scale_weights(spark, sf):
    """Users stand for queries and event types for scales; some weights are missing."""
    gone = (F.col("user_id") % 5 == 0) & (F.col("event_type") == "view")
    sums = X.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("weight"))
    rows = sums.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("scale"), F.when(~gone, F.col("weight")).alias("weight"))
    return T.scale_weights(rows)
