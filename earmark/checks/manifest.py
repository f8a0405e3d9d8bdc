"""Registered queries for manifests, links and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark import pipeline
from earmark.checks.matching_sql import P
from earmark.checks.support import Query, r6, tidy
from earmark.functions.columns import safe_name as safe_name_column
from earmark.functions.columns import sanitize_floats as sanitize
from earmark.operators import fusion as Q
from earmark.session import shared_folder
from earmark.sources import manifest as M
from earmark.sources import sinks

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            ORACLES[name] = P.sql(sql)
        return fn

    return wrap


def _new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Pages as manifest rows: some addresses are blank, some of those name a file instead.
_RAW_COLUMNS = {
    "id": "CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'page' || page_id END",
    "title": "CASE WHEN page_id % 5 = 0 THEN '  ' ELSE 'Title ' || page_id END",
    "url": "CASE WHEN page_id % 3 = 0 THEN '   ' ELSE url END",
    "path": "CASE WHEN page_id % 3 = 0 AND page_id % 6 = 0 THEN '/music/' || page_id || '.wav' END",
    "genre": "'test'",
}
P.add("raw_manifest", "SELECT page_id, " + ", ".join(f"{e} AS {n}" for n, e in _RAW_COLUMNS.items()) + ", coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN '   ' ELSE url END), ''), "
      "CASE WHEN page_id % 6 = 0 THEN '/music/' || page_id || '.wav' END) AS locator FROM pages")


def _raw(spark, sf):
    return X.table(spark, sf, "pages").selectExpr("page_id", *[f"{e} AS {n}" for n, e in _RAW_COLUMNS.items()])


@register("manifest_scan", "SELECT id, trim(title) AS title, genre, locator FROM raw_manifest")
def manifest_scan(spark, sf):
    """The rows go through a CSV file first."""
    folder = _new_folder(spark, "manifest")
    _raw(spark, sf).drop("page_id").write.option("header", True).csv(folder)
    return M.manifest_scan(spark, folder).select("id", F.coalesce(F.trim("title"), F.lit("")).alias("title"), "genre", "locator")


P.add("listing", "SELECT '/music/' || page_id || '.wav' AS path, page_id % 12 = 0 AS readable FROM pages WHERE page_id % 18 <> 0")


def _checked(spark, sf):
    listing = X.table(spark, sf, "pages").where("page_id % 18 <> 0").selectExpr("'/music/' || page_id || '.wav' AS path", "page_id % 12 = 0 AS readable")
    return M.manifest_validate(_raw(spark, sf), listing)


P.add(
    "validated",
    "SELECT m.page_id, m.locator, CASE WHEN m.locator IS NULL THEN 'blank locator' WHEN m.locator LIKE 'http%' THEN NULL WHEN l.path IS NULL THEN 'missing file' WHEN NOT l.readable THEN 'unreadable' END AS reason "
    "FROM raw_manifest m LEFT JOIN listing l ON l.path = m.locator",
)


@register("manifest_validate", "SELECT page_id, locator, reason FROM validated")
def manifest_validate(spark, sf):
    valid, rejects = _checked(spark, sf)
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects).select("page_id", "locator", "reason")


@register("batch_outcome_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS successful, count(*) FILTER (WHERE reason IS NOT NULL) AS failed FROM validated")
def batch_outcome_summary(spark, sf):
    return M.batch_outcome_summary(manifest_validate(spark, sf).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed")))


@register("batch_failures", "SELECT reason, count(*) AS failures FROM validated WHERE reason IS NOT NULL GROUP BY reason")
def batch_failures(spark, sf):
    return M.batch_failures(manifest_validate(spark, sf).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed")))


@register(
    "manifest_enrich",
    f"SELECT id2 AS id, CASE WHEN trim(title) = '' THEN id2 ELSE title END AS title, locator LIKE 'http%' AS is_url, CASE WHEN locator LIKE 'http%' THEN locator END AS source_url, "
    f"CASE WHEN locator NOT LIKE 'http%' THEN locator END AS source_path, {r6('samples / 44100')} AS duration FROM (SELECT *, coalesce(id, 'file_' || (row_number() OVER (ORDER BY page_id) - 1)) AS id2 FROM ("
    "SELECT m.*, length(p.html) AS samples FROM raw_manifest m JOIN pages p USING (page_id) WHERE m.locator IS NOT NULL))",
)
def manifest_enrich(spark, sf):
    sizes = X.table(spark, sf, "pages").select("page_id", F.length("html").alias("samples"), F.lit(44100).alias("sample_rate"))
    rows = M.with_locator(_raw(spark, sf)).where("locator IS NOT NULL").join(sizes, "page_id")
    return M.manifest_enrich(rows, [F.col("page_id")]).select("id", "title", "is_url", "source_url", "source_path", "duration")


@register(
    "content_checksum",
    "SELECT doc_id, checksum, copies, copies > 1 AS is_duplicate FROM (SELECT doc_id, sha256(text) AS checksum, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents)",
)
def content_checksum(spark, sf):
    return M.content_checksum(X.table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "checksum", "copies", "is_duplicate")


_title = "array_to_string(list_transform(string_split(replace({s}, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
P.add("audio_paths", "SELECT '/music/' || lang || '/' || source || '_take_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.mp3' ELSE '.txt' END AS path, source || '_take_' || doc_id AS stem FROM documents")


@register("manifest_from_listing", f"SELECT stem AS id, {_title.format(s='stem')} AS title, path AS url, 'test' AS genre FROM audio_paths WHERE path NOT LIKE '%.txt'")
def manifest_from_listing(spark, sf):
    paths = X.table(spark, sf, "documents").selectExpr(
        "'/music/' || lang || '/' || source || '_take_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.mp3' ELSE '.txt' END AS path"
    )
    return M.manifest_from_listing(paths)


_path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
P.add(
    "url_stems",
    f"SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS n, regexp_replace(regexp_replace(url_decode(regexp_extract({_path}, '([^/]+)/*$', 1)), '[<>:\"/\\\\|?*]', '_', 'g'), '^(.+)\\.[^.]*$', '\\1') AS stem "
    "FROM (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'https://host.example/' || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'My%20Song%3A' || page_id || '_mix.mp3?x=1' ELSE '_.wav#t' END ELSE url END AS url FROM pages)",
)


@register(
    "manifest_from_urls",
    "SELECT CASE WHEN count(DISTINCT url) OVER (PARTITION BY id) > 1 THEN id || '_' || substr(md5(url), 1, 12) ELSE id END AS id, title, url, genre FROM ("
    "SELECT CASE WHEN c = '' OR c = '_' THEN 'track_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END ELSE c END AS id, url_decode(replace(replace(stem, '_', ' '), '%20', ' ')) AS title, url, 'hip hop' AS genre "
    "FROM (SELECT *, substr(regexp_replace(stem, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 50) AS c FROM url_stems))",
)
def manifest_from_urls(spark, sf):
    """Page addresses, some replaced by encoded names, bare hosts and names without letters."""
    special = "'https://host.example/' || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'My%20Song%3A' || page_id || '_mix.mp3?x=1' ELSE '_.wav#t' END"
    urls = X.table(spark, sf, "pages").selectExpr("page_id", f"CASE WHEN page_id % 10 = 3 THEN {special} ELSE url END AS url")
    return M.manifest_from_urls(urls, [F.col("page_id")])


P.add("old_manifest", "SELECT 'track' || row_number() OVER (ORDER BY doc_id) AS id, source AS title, '/music/' || doc_id || '.wav' AS file_path FROM documents WHERE lang = 'en'")


@register(
    "manifest_upsert",
    "SELECT id, title, file_path FROM old_manifest UNION ALL SELECT 'track' || ((SELECT count(*) FROM old_manifest) + row_number() OVER (ORDER BY file_path)) AS id, title, file_path FROM ("
    "SELECT source AS title, '/music/' || doc_id || '.wav' AS file_path FROM documents) WHERE file_path NOT IN (SELECT file_path FROM old_manifest)",
)
def manifest_upsert(spark, sf):
    docs = X.table(spark, sf, "documents")
    path = F.concat(F.lit("/music/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file_path")
    old = M.number_all(docs.where("lang = 'en'").select("doc_id", F.col("source").alias("title"), path), [F.col("doc_id")], "_n", 1)
    old = old.select(F.concat(F.lit("track"), F.col("_n").cast("string")).alias("id"), "title", "file_path")
    return M.manifest_upsert(old, docs.select(F.lit(None).cast("string").alias("id"), F.col("source").alias("title"), path))


@register("duration_filter", f"SELECT doc_id, {r6('n_chars / 100')} AS duration FROM documents WHERE n_chars / 100 BETWEEN 5 AND 30")
def duration_filter(spark, sf):
    return M.duration_filter(X.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 100).alias("duration")), 5, 30)


# Project files beside, above or named like some of the tracks.
_PROJECT_FILES = (
    "SELECT CASE doc_id % 6 WHEN 0 THEN '/lib/' || source || '/' || lang || '/t' || doc_id || '.flp' WHEN 1 THEN '/lib/' || source || '/t' || doc_id || '.logicx' "
    "WHEN 2 THEN '/lib/' || source || '/' || lang || '/t' || doc_id || '_master.als' WHEN 3 THEN '/lib/' || source || '/' || lang || '/t' || doc_id || '.ALS' ELSE '/other/t' || doc_id || '.als' END AS path FROM {t} "
    "UNION ALL SELECT '/lib/' || source || '/' || lang || '/t' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.logic' WHEN 1 THEN '_mix.flp' WHEN 2 THEN '_export.als' ELSE '.txt' END FROM {t}"
)
P.add("project_files", _PROJECT_FILES.format(t="documents"))
_EXT = list(M.PROJECT_TYPES)
_places = [("folder", "", e) for e in _EXT] + [("parent", "", e) for e in _EXT] + [("folder", x, e) for e in _EXT for x in M.PROJECT_ENDINGS if x]


@register(
    "link_projects",
    "SELECT id, file_path, (SELECT arg_min(f.path, p.i) FROM project_files f, (VALUES "
    + ", ".join(f"({i}, '{w}', '{x}.{e}')" for i, (w, x, e) in enumerate(_places))
    + ") p(i, place, ending) WHERE f.path = CASE p.place WHEN 'folder' THEN folder ELSE parent END || '/' || stem || p.ending) AS project_path FROM ("
    "SELECT 'doc' || doc_id AS id, '/lib/' || source || '/' || lang || '/t' || doc_id || '.wav' AS file_path, '/lib/' || source || '/' || lang AS folder, '/lib/' || source AS parent, 't' || doc_id AS stem FROM documents)",
)
def link_projects(spark, sf):
    docs = X.table(spark, sf, "documents")
    docs.createOrReplaceTempView("_link_documents")
    files = spark.sql(_PROJECT_FILES.format(t="_link_documents"))
    tracks = docs.selectExpr("'doc' || doc_id AS id", "'/lib/' || source || '/' || lang || '/t' || doc_id || '.wav' AS file_path")
    return M.link_projects(tracks, files)


@register(
    "detect_project_type",
    "SELECT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'als' THEN 'ableton' WHEN 'flp' THEN 'flstudio' WHEN 'logicx' THEN 'logic' WHEN 'logic' THEN 'logic' END AS project_type FROM project_files",
)
def detect_project_type(spark, sf):
    X.table(spark, sf, "documents").createOrReplaceTempView("_link_documents")
    return spark.sql(_PROJECT_FILES.format(t="_link_documents")).withColumn("project_type", M.detect_project_type(F.col("path")))


P.add("user_notes", "SELECT 'track' || user_id AS id, count(*) AS notes, 'v' || (user_id % 4) AS version FROM events GROUP BY user_id")


@register(
    "project_metadata_resolve",
    "SELECT id, CASE WHEN version = 'v0' THEN notes WHEN version <> 'v3' THEN notes + 1000 END AS notes, CASE WHEN version <> 'v3' THEN version END AS version, "
    "CASE WHEN version = 'v0' THEN 'stored' WHEN version <> 'v3' THEN 'parsed' END AS metadata_source FROM user_notes",
)
def project_metadata_resolve(spark, sf):
    known = X.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("notes")).select(
        F.concat(F.lit("track"), F.col("user_id").cast("string")).alias("id"), "notes", F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("version")
    )
    parsed = known.where("version <> 'v3'").withColumn("notes", F.col("notes") + 1000)
    return M.project_metadata_resolve(known.select("id"), known.where("version = 'v0'"), parsed, ["notes", "version"])


@register(
    "result_sink",
    f"SELECT 'summary' AS part, query_id, top_match_id AS cand_id, top_match_rank AS rank, {r6('top_match_similarity')} AS similarity FROM summary UNION ALL "
    f"SELECT 'stored', query_id, cand_id, rank, {r6('mean_similarity')} FROM cands WHERE rank <= 20",
)
def result_sink(spark, sf):
    """Summary and nested candidate lists are written for a run and read back."""
    folder = _new_folder(spark, "results")
    stored = Q.store_limit(X.candidates(spark, sf), 20)
    for _ in range(2):  # writing a run again replaces it
        sinks.write_results(folder, "run_1", summary=X.summary(spark, sf), stored=stored)
    table = spark.read.schema("query_id string, top_match_id string, top_match_rank int, top_match_similarity double, run_id string").option("header", True).option("enforceSchema", False)
    names = [c for c in X.summary(spark, sf).columns]
    summary = table.schema(", ".join(f"{n} {'double' if 'similarity' in n or 'latency' in n else 'string'}" for n in names)).csv(f"{folder}/query_summary/run_id=run_1")
    lists = spark.read.schema(stored.schema).json(f"{folder}/query_results/run_id=run_1")
    flat = lists.select("query_id", F.inline("top_candidates"))
    return summary.select(F.lit("summary").alias("part"), "query_id", F.col("top_match_id").alias("cand_id"), F.col("top_match_rank").cast("bigint").alias("rank"), F.col("top_match_similarity").alias("similarity")).unionByName(
        flat.select(F.lit("stored").alias("part"), "query_id", "cand_id", F.col("rank").cast("bigint").alias("rank"), F.col("mean_similarity").alias("similarity"))
    )


P.add(
    "runs",
    "SELECT 'run_' || user_id AS run_id, count(*) AS n, user_id % 6 AS kind, user_id % 2 = 0 AS has_summary, CAST(floor(epoch(max(ts))) AS BIGINT) AS modified FROM events GROUP BY user_id",
)


@register(
    "run_catalog",
    "SELECT run_id, kind <> 5 AS has_metrics, has_summary, modified, CASE WHEN kind <> 5 THEN n END AS total_queries, "
    "CASE kind WHEN 0 THEN 'phase1' WHEN 1 THEN 'phase2' WHEN 2 THEN 'phase1' WHEN 3 THEN 'phase2' WHEN 4 THEN 'unknown' END AS phase, CASE WHEN kind <> 5 AND has_summary THEN 'complete' ELSE 'incomplete' END AS state FROM runs",
)
def run_catalog(spark, sf):
    """One run for each user, whose phase is written in different places or nowhere."""
    per_user = X.table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.unix_timestamp(F.max("ts").cast("timestamp"))).cast("bigint").alias("modified")
    ).withColumn("kind", F.col("user_id") % 6)
    phase = F.when(F.col("kind") == 0, "phase1").when(F.col("kind") == 3, "unknown")
    details = F.struct(F.when(F.col("kind") == 1, "phase2").alias("phase"), F.when(F.col("kind") == 2, "conf/Phase_1.yaml").when(F.col("kind") == 3, "conf/phase2.yaml").alias("config_file"))
    metrics = F.to_json(F.struct(F.struct(phase.alias("phase"), F.col("n").alias("total_queries")).alias("summary"), details.alias("test_details")))
    runs = per_user.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.when(F.col("kind") != 5, metrics).alias("metrics"), (F.col("user_id") % 2 == 0).alias("has_summary"), "modified"
    )
    return M.run_catalog(runs)


@register(
    "sanitize_floats",
    f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE {r6('value')} END AS x, {r6('value')} AS first, CASE WHEN event_id % 5 < 3 THEN NULL ELSE {r6('value')} END AS second, CASE WHEN event_id % 5 < 3 THEN NULL ELSE {r6('value')} END AS inner_x FROM events",
)
def sanitize_floats(spark, sf):
    odd = F.col("event_id") % 5
    x = F.when(odd == 0, float("nan")).when(odd == 1, float("inf")).when(odd == 2, float("-inf")).otherwise(F.col("value"))
    rows = X.table(spark, sf, "events").select("event_id", x.alias("x"), F.array(F.col("value"), x).alias("xs"), F.struct(x.alias("x")).alias("s"))
    return sanitize(rows).select("event_id", "x", F.col("xs")[0].alias("first"), F.col("xs")[1].alias("second"), F.col("s.x").alias("inner_x"))


@register("safe_name", "SELECT page_id, translate(url, '/\\:*?\"<>|', '_________') AS name FROM pages")
def safe_name(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", safe_name_column(F.col("url")).alias("name"))


@register(
    "run_catalog_stored",
    "SELECT run_id, true AS has_metrics, true AS has_summary, count(*) AS total_queries, phase, 'complete' AS state FROM judged, "
    "(VALUES ('run_1', 'phase1'), ('run_2', 'phase2')) t(run_id, phase) GROUP BY ALL",
)
def run_catalog_stored(spark, sf):
    """Two judged runs are stored, one of them twice, and the folder is read as a catalogue."""
    folder = _new_folder(spark, "runs")
    run = pipeline.judge(X.candidates(spark, sf), X.latency(spark, sf), X.truth(spark, sf))
    for run_id, phase in (("run_1", "phase1"), ("run_2", "phase1"), ("run_2", "phase2")):
        pipeline.store(run, folder, run_id, 20, phase)
    return M.run_catalog(pipeline.read_runs(spark, folder)).drop("modified")
