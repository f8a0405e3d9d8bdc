"""Registered queries for vote fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.checks import signal
from earmark.checks.matching_sql import FILTER_THRESHOLD, P, run_parts, vote_parts
from earmark.checks.support import Query, r6, tidy
from earmark.operators import fusion as Q
from earmark.operators import signal as A
from earmark.pipeline import search_by_severity, severity_thresholds
from earmark.session import cut_lineage

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            ORACLES[name] = P.sql(sql)
        return fn

    return wrap


_HIT = f"query_id, scale, segment_idx, {r6('scale_weight')} AS scale_weight, cand_id, rank, {r6('similarity')} AS similarity"


@register("track_grain", f"SELECT {_HIT} FROM hits")
def track_grain(spark, sf):
    return Q.to_track_grain(X.segment_hits(spark, sf))


@register("filter_segments", f"SELECT {_HIT} FROM hits SEMI JOIN passing USING (query_id, scale, segment_idx)")
def filter_segments(spark, sf):
    return Q.filter_segments(X.hits(spark, sf), FILTER_THRESHOLD)


P.add(
    "adapted",
    "SELECT query_id, m AS mean_top_similarity, greatest(0.18, greatest(0.1, least(0.4, 0.2 - (m - 0.5) * 0.1))) AS threshold "
    "FROM (SELECT query_id, avg(top_similarity) AS m FROM tops GROUP BY query_id)",
)


@register("adaptive_threshold", f"SELECT query_id, {r6('mean_top_similarity')} AS mean_top_similarity, {r6('threshold')} AS threshold FROM adapted")
def adaptive_threshold(spark, sf):
    return Q.adaptive_threshold(X.hits(spark, sf), threshold=0.2)


@register(
    "filter_segments_adaptive",
    f"SELECT {_HIT} FROM hits SEMI JOIN (SELECT * FROM (SELECT t.*, a.threshold * 2 AS th, count(*) OVER (PARTITION BY query_id) AS n, "
    "count(*) FILTER (WHERE top_similarity >= a.threshold * 2) OVER (PARTITION BY query_id) AS k FROM tops t JOIN adapted a USING (query_id)) "
    "WHERE top_similarity >= th OR k < n * 0.3) USING (query_id, scale, segment_idx)",
)
def filter_segments_adaptive(spark, sf):
    found = X.hits(spark, sf)
    limits = Q.adaptive_threshold(found, threshold=0.2).withColumn("threshold", F.col("threshold") * 2)
    return Q.filter_segments(found, limits)


@register("keep_best_segments", f"SELECT {_HIT} FROM kept")
def keep_best_segments(spark, sf):
    return Q.keep_best_segments(Q.filter_segments(X.hits(spark, sf), FILTER_THRESHOLD), 0.6)


@register("temporal_runs", f"SELECT query_id, cand_id, longest_run, total_run, {r6('temporal_score')} AS temporal_score FROM tempo")
def temporal_runs(spark, sf):
    return Q.temporal_runs(X.hits(spark, sf))


_VOTE = (
    "query_id, cand_id, num_segments, match_count, rank_1_count, rank_5_count, "
    + ", ".join(f"{r6(c)} AS {c}" for c in ("weighted_similarity", "geometric_similarity", "avg_similarity", "max_similarity", "avg_rank", "own_similarity"))
    + f", min_rank, {r6('match_ratio')} AS match_ratio"
)
_SCORE = _VOTE + ", " + ", ".join(f"{r6(c)} AS {c}" for c in ("temporal_score", "mean_similarity", "combined_score"))


@register("aggregate_candidates", f"SELECT {_VOTE} FROM votes")
def aggregate_candidates(spark, sf):
    return Q.aggregate_candidates(X.hits(spark, sf))


@register("combined_score", f"SELECT {_SCORE}, rank FROM cands")
def combined_score(spark, sf):
    found = X.hits(spark, sf)
    return Q.combined_score(Q.aggregate_candidates(found), Q.temporal_runs(found))


_RERANK = _SCORE + ", " + ", ".join(f"{r6(c)} AS {c}" for c in ("consistency_score", "scale_consistency", "rerank_score"))


@register("second_stage_rerank", f"SELECT {_RERANK}, rank FROM reranked")
def second_stage_rerank(spark, sf):
    return Q.second_stage_rerank(X.candidates(spark, sf), X.hits(spark, sf), 5)


def _reranked(spark, sf):
    return X._once(spark, sf, "reranked", lambda: second_stage_rerank(spark, sf))


@register("quality_score", f"SELECT query_id, cand_id, rank, {r6('quality_score')} AS quality_score, quality_score >= 0.2 AS validated FROM quality")
def quality_score(spark, sf):
    return Q.quality_score(_reranked(spark, sf), 0.2).select("query_id", "cand_id", "rank", "quality_score", "validated")


def _confident(spark, sf):
    return Q.confidence(Q.quality_score(_reranked(spark, sf)))


@register("confidence", f"SELECT query_id, cand_id, rank, {r6('confidence')} AS confidence FROM confident")
def confidence(spark, sf):
    return _confident(spark, sf).select("query_id", "cand_id", "rank", "confidence")


@register("confidence_rerank", f"SELECT query_id, cand_id, rank, {r6('confidence')} AS confidence, {r6('combined_score')} AS combined_score FROM final")
def confidence_rerank(spark, sf):
    return Q.confidence_rerank(_confident(spark, sf)).select("query_id", "cand_id", "rank", "confidence", "combined_score")


@register(
    "min_confidence_filter",
    f"SELECT query_id, cand_id, {r6('confidence')} AS confidence FROM (SELECT *, max(confidence) OVER (PARTITION BY query_id) AS best FROM confident) WHERE confidence >= 0.45 OR best < 0.45",
)
def min_confidence_filter(spark, sf):
    return Q.min_confidence_filter(_confident(spark, sf), 0.45).select("query_id", "cand_id", "confidence")


@register(
    "similarity_gate",
    f"SELECT c.query_id, c.cand_id, t.severity, {r6('c.own_similarity')} AS own_similarity FROM cands c LEFT JOIN truth t USING (query_id) "
    "WHERE own_similarity >= CASE severity WHEN 'severe' THEN 0.85 WHEN 'moderate' THEN 0.90 ELSE 0.95 END",
)
def similarity_gate(spark, sf):
    severities = X.truth(spark, sf).select("query_id", "severity")
    return Q.similarity_gate(X.candidates(spark, sf), severities).select("query_id", "cand_id", "severity", "own_similarity")


P.add("k_tempo", run_parts("best_tops", "k_tempo"))
P.add("k_votes", vote_parts("kept"))


P.add("k_scores", P.parts["scores"].replace("FROM votes v LEFT JOIN tempo", "FROM k_votes v LEFT JOIN k_tempo"))
P.add("k_cands", P.parts["cands"].replace("FROM scores", "FROM k_scores"))
P.add("k_reranked", P.parts["reranked"].replace("FROM cands", "FROM k_cands").replace("FROM hits h", "FROM kept h"))
P.add("k_quality", P.parts["quality"].replace("FROM reranked", "FROM k_reranked"))
P.add("k_confident", P.parts["confident"].replace("FROM quality", "FROM k_quality"))
P.add("k_final", P.parts["final"].replace("FROM confident", "FROM k_confident"))


@register(
    "fuse",
    f"SELECT query_id, cand_id, rank, {r6('combined_score')} AS combined_score, {r6('quality_score')} AS quality_score, {r6('confidence')} AS confidence FROM k_final",
)
def fuse(spark, sf):
    """The whole chain with its defaults, on segments that pass the filter."""
    done = Q.fuse(X.hits(spark, sf), Q.FusionConfig(threshold=FILTER_THRESHOLD))
    return done.select("query_id", "cand_id", "rank", "combined_score", "quality_score", "confidence")


P.add(
    "rrf",
    "SELECT query_id, cand_id, sum(similarity * scale_weight / r) AS score, greatest(0.0, max(similarity)) AS similarity, min(r) AS min_rank, count(*) AS segment_count, "
    "count(*) FILTER (WHERE r <= 5) AS rank_5_count, count(*) FILTER (WHERE r <= 10) AS rank_10_count FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id, scale, segment_idx ORDER BY rank) AS r FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id, scale, segment_idx) AS best FROM hits) "
    "WHERE similarity >= 0.3 OR (best < 0.3 AND rank = 1)) GROUP BY query_id, cand_id",
)


@register(
    "reciprocal_rank_fusion",
    f"SELECT query_id, cand_id, {r6('score')} AS score, {r6('similarity')} AS similarity, min_rank, segment_count, rank_5_count, rank_10_count, "
    "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM rrf",
)
def reciprocal_rank_fusion(spark, sf):
    return Q.reciprocal_rank_fusion(X.hits(spark, sf), 0.3)


@register(
    "adjacent_boost",
    f"SELECT query_id, cand_id, {r6('s')} AS score, adjacent_pairs, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cand_id) AS rank FROM ("
    "SELECT query_id, cand_id, coalesce(n, 0) AS adjacent_pairs, score * pow(1.15, coalesce(n, 0)) AS s FROM rrf LEFT JOIN ("
    "SELECT a.query_id, a.cand_id, count(*) AS n FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.scale = b.scale AND a.cand_id = b.cand_id AND b.segment_idx = a.segment_idx + 1 "
    "WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY ALL) USING (query_id, cand_id))",
)
def adjacent_boost(spark, sf):
    found = X.hits(spark, sf)
    return Q.adjacent_boost(Q.reciprocal_rank_fusion(found, 0.3), found).select("query_id", "cand_id", "score", "adjacent_pairs", "rank")


@register(
    "run_boost",
    f"SELECT query_id, scale, segment_idx, cand_id, rank, longest AS longest_run, {r6('CASE WHEN longest >= 2 THEN least(1.0, similarity * (1 + (longest - 1) * 0.05)) ELSE similarity END')} AS similarity FROM hits JOIN ("
    "SELECT query_id, scale, cand_id, max(n) AS longest FROM (SELECT query_id, scale, cand_id, grp, count(*) AS n FROM ("
    "SELECT query_id, scale, cand_id, segment_idx - row_number() OVER (PARTITION BY query_id, scale, cand_id ORDER BY segment_idx) AS grp FROM hits) GROUP BY ALL) GROUP BY ALL) USING (query_id, scale, cand_id)",
)
def run_boost(spark, sf):
    return Q.run_boost(X.hits(spark, sf)).drop("scale_weight")


for _name in ("samples", "framed", "spectrum", "band8", "ratios"):
    P.add(_name, signal.P.parts[_name])


@register(
    "band_reweight",
    f"SELECT query_id, scale, segment_idx, cand_id, rank, {r6('CASE WHEN b > 0.4 THEN least(1.0, s1 * (1 + 0.1 * b)) ELSE s1 END')} AS similarity FROM ("
    "SELECT h.*, r.b, CASE WHEN r.l > 0.6 THEN least(1.0, similarity * 1.05) ELSE similarity END AS s1 FROM hits h LEFT JOIN ("
    "SELECT query_id, low_ratio AS l, bass_ratio AS b FROM truth t JOIN ratios r ON t.track_id = 'track' || r.track_id) r USING (query_id))",
)
def band_reweight(spark, sf):
    """Ratios from the samples of the track that a query was made from; queries without samples stay as they are."""
    measured = A.band_ratios(X.samples(spark, sf), signal.WIDE, frame=signal.FRAME, top_hz=signal.WIDE / 2)
    named = measured.withColumn("track_id", F.concat(F.lit("track"), F.col("track_id").cast("string")))
    ratios = X.truth(spark, sf).join(named, "track_id").select("query_id", "low_ratio", "bass_ratio")
    return Q.band_reweight(X.hits(spark, sf), ratios).drop("scale_weight")


@register(
    "ensemble_variants",
    f"SELECT query_id, cand_id, {r6('cs')} AS combined_score, {r6('cf')} AS confidence, rank_1_count, {r6('ts')} AS temporal_score, variant_count, variants, rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, cand_id) AS rank FROM (SELECT track_id AS query_id, cand_id, avg(combined_score * w) AS cs, avg(confidence * w) AS cf, "
    "CAST(sum(rank_1_count) AS BIGINT) AS rank_1_count, avg(temporal_score) AS ts, count(*) AS variant_count, "
    """'["' || array_to_string(list_sort(list(DISTINCT variant)), '","') || '"]' AS variants FROM ("""
    "SELECT t.track_id, CASE t.severity WHEN 'mild' THEN 'original' ELSE t.severity END AS variant, CASE t.severity WHEN 'mild' THEN 1.0 ELSE 0.7 END AS w, c.* "
    "FROM confident c JOIN truth t USING (query_id)) GROUP BY track_id, cand_id)) WHERE rank <= 10",
)
def ensemble_variants(spark, sf):
    """The three masked copies of a track stand for three variants of one query."""
    variant = F.when(F.col("severity") == "mild", "original").otherwise(F.col("severity")).alias("variant")
    named = X.truth(spark, sf).select("query_id", "track_id", variant)
    rows = _confident(spark, sf).join(named, "query_id").drop("query_id").withColumnRenamed("track_id", "query_id")
    return Q.ensemble_variants(rows, 10)


@register("merge_scales", f"SELECT query_id, scale, segment_idx, cand_id, rank, {r6('CASE scale WHEN 1000 THEN 0.3 / 0.7 ELSE 0.4 / 0.7 END')} AS scale_weight FROM hits")
def merge_scales(spark, sf):
    found = X.hits(spark, sf)
    merged = Q.merge_scales([found.where("scale = 1000"), found.where("scale = 2000")], [0.3, 0.4])
    return merged.drop("similarity")


@register(
    "scale_decision",
    f"SELECT query_id, {r6('a')} AS agreement, a < l AS needs_scales, CASE WHEN a < l THEN '[{{\"scale\":3000,\"weight\":0.3}},{{\"scale\":5000,\"weight\":0.4}}]' END AS extra_scales, "
    "CASE WHEN a < l THEN least(80, cap) ELSE 40 END AS k FROM (SELECT query_id, max(v) / sum(v) AS a FROM (SELECT query_id, top_id, count(*) AS v FROM tops GROUP BY ALL) GROUP BY query_id) JOIN ("
    "SELECT query_id, CASE severity WHEN 'severe' THEN 0.75 WHEN 'moderate' THEN 0.88 ELSE 0.0 END AS l, CASE severity WHEN 'severe' THEN 100 WHEN 'moderate' THEN 60 ELSE 40 END AS cap FROM truth) USING (query_id)",
)
def scale_decision(spark, sf):
    return Q.scale_decision(X.hits(spark, sf), X.truth(spark, sf).select("query_id", "transform_type", "severity"), 40)


P.add(
    "leads",
    "SELECT query_id, scale, top_id AS cand_id, count(*) / max(n) AS r1, max(top_similarity) AS mx, avg(top_similarity) AS mean FROM "
    "(SELECT *, count(*) OVER (PARTITION BY query_id, scale) AS n FROM tops) GROUP BY ALL",
)
_clear = "((r1 >= 0.8 AND mx >= 0.9) OR mx >= 0.95 OR (mean >= 0.92 AND r1 >= 0.7)) AND least(1.0, mean * r1) >= 0.95"


@register(
    "confident_match",
    f"SELECT query_id, scale, cand_id, {r6('r1')} AS rank_1_ratio, {r6('mx')} AS max_similarity, {r6('mean')} AS mean_similarity, {r6('least(1.0, mean * r1)')} AS confidence, {_clear} AS confident FROM leads",
)
def confident_match(spark, sf):
    """In each scale alone."""
    return Q.confident_match(X.hits(spark, sf), by_scale=True)


# Search in two rounds with settings by severity.
P.add("ms_set", "SELECT query_id, severity, greatest(10, CASE severity WHEN 'severe' THEN 26 WHEN 'moderate' THEN 22 ELSE 20 END) AS k0 FROM truth")


def _grain(source: str) -> str:
    return (
        "SELECT *, row_number() OVER (PARTITION BY query_id, scale, segment_idx ORDER BY similarity DESC, cand_id) AS rank FROM ("
        "SELECT query_id, scale, segment_idx, scale_weight, split_part(cand_id, '_seg_', 1) AS cand_id, max(similarity) AS similarity FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY query_id, scale, segment_idx ORDER BY similarity DESC, cand_id) AS r FROM {source}) WHERE r <= depth GROUP BY ALL)"
    )


P.add("ms_near", "SELECT s.*, m.k0 AS depth FROM scored s JOIN ms_set m USING (query_id)")
P.add("ms_first", _grain("ms_near"))
P.add("ms_tops1", "SELECT query_id, scale, segment_idx, cand_id AS top_id, similarity AS top_similarity FROM ms_first WHERE rank = 1")
P.add("ms_lead", P.parts["leads"].replace("FROM tops", "FROM ms_tops1"))
P.add(
    "ms_again",
    "SELECT query_id, least(2 * k0, CASE severity WHEN 'severe' THEN 100 WHEN 'moderate' THEN 60 ELSE 40 END) AS depth FROM ms_set JOIN ("
    "SELECT query_id, max(v) / sum(v) AS a FROM (SELECT query_id, top_id, count(*) AS v FROM ms_tops1 GROUP BY ALL) GROUP BY query_id) USING (query_id) "
    "WHERE a < CASE severity WHEN 'severe' THEN 0.75 WHEN 'moderate' THEN 0.88 ELSE 0.0 END "
    f"AND query_id NOT IN (SELECT query_id FROM ms_lead WHERE {_clear})",
)
P.add(
    "ms_wide",
    "SELECT query_id, scale, scale_weight, segment_idx, depth, list_transform(v, lambda x: x / (CASE WHEN sqrt(list_dot_product(v, v)) > 0 THEN sqrt(list_dot_product(v, v)) ELSE 1 END)) AS vector FROM ("
    "SELECT query_id, scale, scale_weight, segment_idx, depth, list(x ORDER BY d) AS v FROM ("
    "SELECT a.query_id, w.scale, w.scale_weight, a.segment_idx, g.depth, d, avg(b.vector[d]) AS x FROM ms_again g JOIN mask a USING (query_id) "
    "JOIN (VALUES (3, 3000, 0.3::DOUBLE), (5, 5000, 0.4::DOUBLE)) w(n, scale, scale_weight) ON a.segment_idx + w.n <= 5 "
    "JOIN mask b ON b.query_id = a.query_id AND b.segment_idx BETWEEN a.segment_idx AND a.segment_idx + w.n - 1, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL) GROUP BY ALL)",
)
P.add(
    "ms_wide_near",
    "SELECT q.query_id, q.scale, q.segment_idx, q.scale_weight, c.cand_id, (round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) + 0.0 AS similarity, q.depth FROM ms_wide q, cat c",
)
P.add("ms_second", _grain("ms_wide_near"))
P.add(
    "ms_hits",
    "SELECT * REPLACE (scale_weight / total AS scale_weight) FROM (SELECT * FROM ms_first UNION ALL SELECT * FROM ms_second) JOIN ("
    "SELECT query_id, sum(w) AS total FROM (SELECT DISTINCT query_id, scale, scale_weight AS w FROM (SELECT * FROM ms_first UNION ALL SELECT * FROM ms_second)) GROUP BY query_id) USING (query_id)",
)
P.add("ms_tops", "SELECT query_id, scale, segment_idx, cand_id AS top_id, similarity AS top_similarity FROM ms_hits WHERE rank = 1")
P.add(
    "ms_limit",
    "SELECT query_id, CASE severity WHEN 'severe' THEN greatest(0.18, t) WHEN 'moderate' THEN greatest(0.22, t) ELSE t END AS threshold FROM ms_set JOIN ("
    "SELECT query_id, greatest(0.1, least(0.4, 0.2 - (avg(top_similarity) - 0.5) * 0.1)) AS t FROM ms_tops GROUP BY query_id) USING (query_id)",
)
P.add(
    "ms_pass",
    "SELECT query_id, scale, segment_idx, top_id, top_similarity FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, "
    "count(*) FILTER (WHERE top_similarity >= threshold) OVER (PARTITION BY query_id) AS n_pass FROM ms_tops JOIN ms_limit USING (query_id)) "
    "WHERE top_similarity >= threshold OR n_pass < n * 0.3",
)
P.add("ms_kept", "SELECT h.* FROM ms_hits h SEMI JOIN ms_pass b USING (query_id, scale, segment_idx)")
P.add("ms_tempo", run_parts("ms_pass", "ms_tempo"))
P.add("ms_votes", vote_parts("ms_kept"))
P.add("ms_scores", P.parts["scores"].replace("FROM votes v LEFT JOIN tempo", "FROM ms_votes v LEFT JOIN ms_tempo"))


def _two_rounds(spark, sf):
    variants = X.truth(spark, sf).select("query_id", "transform_type", "severity")
    return search_by_severity(X.queries(spark, sf), X.corpus(spark, sf), variants, lambda wanted: X.wider_scales(spark, sf, wanted), X.HITS_PER_SEGMENT)


@register(
    "search_by_severity",
    f"SELECT query_id, scale, segment_idx, cand_id, rank, {r6('similarity')} AS similarity, {r6('scale_weight')} AS scale_weight FROM ms_hits",
)
def search_by_severity_hits(spark, sf):
    """Each query to its own depth; undecided ones again in wider scales."""
    return _two_rounds(spark, sf).hits


@register(
    "match_by_severity",
    f"SELECT query_id, cand_id, {r6('combined_score')} AS combined_score, {r6('mean_similarity')} AS mean_similarity, rank_1_count, match_count, num_segments, "
    "row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, mean_similarity DESC, cand_id) AS rank FROM ms_scores",
)
def match_by_severity(spark, sf):
    """Votes of both rounds, with the threshold of each query."""
    found = _two_rounds(spark, sf)
    found = found._replace(hits=cut_lineage(found.hits))
    kept = cut_lineage(Q.filter_segments(found.hits, severity_thresholds(found)))
    scored = Q.combined_score(cut_lineage(Q.aggregate_candidates(kept)), Q.temporal_runs(kept))
    return scored.select("query_id", "cand_id", "combined_score", "mean_similarity", "rank_1_count", "match_count", "num_segments", "rank")


P.add("seg_tops", "SELECT query_id, scale, segment_idx, cand_id AS top_id FROM seg_hits WHERE rank = 1")
P.add("seg_tempo", run_parts("seg_tops", "seg_tempo"))
P.add("seg_votes", vote_parts("seg_hits"))
P.add("seg_scores", P.parts["scores"].replace("FROM votes v LEFT JOIN tempo", "FROM seg_votes v LEFT JOIN seg_tempo"))


def _segment_candidates(spark, sf):
    found = X.segment_hits(spark, sf)
    return X._once(spark, sf, "segment_candidates", lambda: Q.combined_score(Q.aggregate_candidates(found), Q.temporal_runs(found)))


@register(
    "rollup_to_track",
    f"SELECT query_id, cand_id, {r6('combined_score')} AS combined_score, {r6('mean_similarity')} AS mean_similarity, {r6('own_similarity')} AS own_similarity, rank_1_count, match_count, "
    "row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, mean_similarity DESC, cand_id) AS rank FROM ("
    "SELECT query_id, split_part(cand_id, '_seg_', 1) AS cand_id, max(combined_score) AS combined_score, max(mean_similarity) AS mean_similarity, max(own_similarity) AS own_similarity, "
    "CAST(sum(rank_1_count) AS BIGINT) AS rank_1_count, CAST(sum(match_count) AS BIGINT) AS match_count FROM seg_scores GROUP BY ALL)",
)
def rollup_to_track(spark, sf):
    return Q.rollup_to_track(_segment_candidates(spark, sf))


P.add(
    "proj",
    "SELECT 'track' || user_id AS track_id, CASE user_id % 3 WHEN 0 THEN 'ableton' WHEN 1 THEN 'flstudio' ELSE 'logic' END AS project_type, count(*) AS total_notes, "
    "count(DISTINCT event_type) AS midi_tracks, count(*) FILTER (WHERE event_type = 'signup' AND value > 100) AS automation_tracks FROM events GROUP BY user_id",
)


def project_counts(spark, sf):
    """Note, track and automation counts of projects, one project for each user."""
    kind = F.when(F.col("user_id") % 3 == 0, "ableton").when(F.col("user_id") % 3 == 1, "flstudio").otherwise("logic")
    return (
        X.table(spark, sf, "events")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_notes"),
            F.count_distinct("event_type").alias("midi_tracks"),
            F.count_if((F.col("event_type") == "signup") & (F.col("value") > 100)).alias("automation_tracks"),
        )
        .select(F.concat(F.lit("track"), F.col("user_id").cast("string")).alias("track_id"), kind.alias("project_type"), "total_notes", "midi_tracks", "automation_tracks")
    )


@register(
    "project_filter",
    "SELECT c.query_id, c.cand_id, c.rank FROM cands c LEFT JOIN proj p ON p.track_id = c.cand_id WHERE p.track_id IS NULL OR "
    "(p.project_type = 'ableton' AND p.total_notes >= 10 AND p.midi_tracks >= 2 AND p.automation_tracks > 0)",
)
def project_filter(spark, sf):
    criteria = {"project_type": "ableton", "min_notes": 10, "min_tracks": 2, "has_automation": True}
    return Q.project_filter(X.candidates(spark, sf), project_counts(spark, sf), criteria).select("query_id", "cand_id", "rank")


@register(
    "top_match_summary",
    f"SELECT t.query_id, t.track_id, t.transform_type, t.severity, c.cand_id AS top_match_id, {r6('coalesce(c.own_similarity, 0.0)')} AS top_match_similarity, coalesce(c.rank, -1) AS top_match_rank, "
    "CAST(NULL AS VARCHAR) AS error FROM truth t LEFT JOIN (SELECT * FROM cands WHERE rank = 1 AND mean_similarity >= 0.4) c USING (query_id)",
)
def top_match_summary(spark, sf):
    some = X.candidates(spark, sf).where("mean_similarity >= 0.4")
    return Q.top_match_summary(X.truth(spark, sf), some)


@register(
    "store_limit",
    f"SELECT query_id, rank, cand_id, {r6('mean_similarity')} AS mean_similarity, {r6('combined_score')} AS combined_score FROM cands WHERE rank <= 20",
)
def store_limit(spark, sf):
    return Q.store_limit(X.candidates(spark, sf), 20).select("query_id", F.inline("top_candidates"))
