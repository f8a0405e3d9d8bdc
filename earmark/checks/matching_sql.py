"""SQL twins of the shared tables, for the oracle statements."""

from __future__ import annotations

from earmark.checks.support import Parts
from earmark.fixtures import HITS_PER_SEGMENT, MASKS, SCALE_WEIGHTS

P = Parts()

_unit = "list_transform({v}, lambda x: x / (CASE WHEN {n} > 0 THEN {n} ELSE 1 END))"


def unit(v: str) -> str:
    return _unit.format(v=v, n=f"sqrt(list_dot_product({v}, {v}))")


_first, _second = SCALE_WEIGHTS.items()

P.add(
    "seg",
    "SELECT 'track' || (vec_id // 5) AS track_id, vec_id % 5 AS segment_idx, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings",
)
P.add("cat", f"SELECT track_id || '_seg_' || lpad(CAST(segment_idx AS VARCHAR), 4, '0') AS cand_id, {unit('vector')} AS vector FROM seg")
P.add(
    "mask",
    "SELECT track_id || '_m' || m AS query_id, track_id, m, segment_idx, "
    "list_transform(vector, lambda x, i: CASE WHEN i <= m THEN x ELSE 0.0 END) AS vector "
    f"FROM seg, (VALUES {', '.join(f'({m})' for m in MASKS)}) t(m)",
)
P.add(
    "pooled2",
    "SELECT a.query_id, a.segment_idx, list_transform(list_zip(a.vector, b.vector), lambda p: (p[1] + p[2]) / 2.0) AS vector "
    "FROM mask a JOIN mask b ON a.query_id = b.query_id AND b.segment_idx = a.segment_idx + 1",
)
P.add(
    "qvec",
    f"SELECT query_id, {_first[0]} AS scale, CAST({_first[1]} AS DOUBLE) AS scale_weight, segment_idx, {unit('vector')} AS vector FROM mask "
    f"UNION ALL SELECT query_id, {_second[0]}, CAST({_second[1]} AS DOUBLE), segment_idx, {unit('vector')} FROM pooled2",
)
P.add(
    "scored",
    "SELECT q.query_id, q.scale, q.segment_idx, q.scale_weight, c.cand_id, "
    "(round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) + 0.0 AS similarity FROM qvec q, cat c",
)
P.add(
    "seg_hits",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scale, segment_idx ORDER BY similarity DESC, cand_id) AS rank "
    f"FROM scored) WHERE rank <= {HITS_PER_SEGMENT}",
)
P.add(
    "hits",
    "SELECT *, row_number() OVER (PARTITION BY query_id, scale, segment_idx ORDER BY similarity DESC, cand_id) AS rank FROM ("
    "SELECT query_id, scale, segment_idx, scale_weight, split_part(cand_id, '_seg_', 1) AS cand_id, max(similarity) AS similarity "
    "FROM seg_hits GROUP BY ALL)",
)
P.add("tops", "SELECT query_id, scale, segment_idx, cand_id AS top_id, similarity AS top_similarity FROM hits WHERE rank = 1")
P.add("nseg", "SELECT query_id, count(*) AS num_segments FROM tops GROUP BY query_id")
P.add(
    "truth",
    "SELECT query_id, track_id, 'mask_' || m AS transform_type, CASE m "
    + " ".join(f"WHEN {m} THEN '{s}'" for m, s in MASKS.items())
    + " END AS severity FROM mask WHERE segment_idx = 0",
)
_place = "CASE m " + " ".join(f"WHEN {m} THEN {i}" for i, m in enumerate(MASKS)) + " END"
P.add(
    "lat",
    f"SELECT query_id, 200.0::DOUBLE + value * 8 AS latency_ms FROM (SELECT query_id, CAST(substr(track_id, 6) AS BIGINT) * {len(MASKS)} + {_place} AS event_id FROM mask WHERE segment_idx = 0) JOIN events USING (event_id)",
)

_t = 0.45
P.add(
    "passing",
    "SELECT * EXCLUDE (n, n_pass) FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, "
    f"count(*) FILTER (WHERE top_similarity >= {_t}) OVER (PARTITION BY query_id) AS n_pass FROM tops) "
    f"WHERE top_similarity >= {_t} OR n_pass < n * 0.3",
)
FILTER_THRESHOLD = _t
P.add(
    "best_tops",
    "SELECT query_id, scale, segment_idx, top_id, top_similarity FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, "
    "row_number() OVER (PARTITION BY query_id ORDER BY top_similarity DESC, scale, segment_idx) AS place FROM passing) "
    "WHERE place <= CASE WHEN n > 5 THEN greatest(5, CAST(trunc(n * 0.6) AS BIGINT)) ELSE n END",
)
P.add("kept", "SELECT h.* FROM hits h SEMI JOIN best_tops b USING (query_id, scale, segment_idx)")


def run_parts(source: str, out: str) -> str:
    """Temporal runs of a table of top hits."""
    return (
        "SELECT query_id, top_id AS cand_id, max(len) AS longest_run, CAST(sum(len) AS BIGINT) AS total_run, "
        "max(len) / max(n) * 0.5 + sum(len) / max(n) * 0.5 AS temporal_score FROM ("
        "SELECT query_id, top_id, grp, max(n) AS n, count(*) AS len FROM ("
        "SELECT query_id, top_id, count(*) OVER (PARTITION BY query_id) AS n, "
        "row_number() OVER (PARTITION BY query_id ORDER BY scale, segment_idx) "
        "- row_number() OVER (PARTITION BY query_id, top_id ORDER BY scale, segment_idx) AS grp "
        f"FROM {source}) GROUP BY query_id, top_id, grp) GROUP BY query_id, top_id"
    )


def vote_parts(source: str) -> str:
    """Votes of the candidates of a table of hits."""
    return (
        "SELECT query_id, cand_id, max(num_segments) AS num_segments, count(*) AS match_count, "
        "count(*) FILTER (WHERE rank = 1) AS rank_1_count, count(*) FILTER (WHERE rank <= 5) AS rank_5_count, "
        "CASE WHEN sum(w) > 0 THEN sum(s * w) / sum(w) ELSE avg(s) END AS weighted_similarity, "
        "CASE WHEN min(s) > 0 THEN exp(avg(CASE WHEN s > 0 THEN ln(s) END)) END AS geometric_similarity, "
        "max(similarity) AS own_similarity, avg(s) AS avg_similarity, max(s) AS max_similarity, avg(rank) AS avg_rank, min(rank) AS min_rank, "
        "count(*) / max(num_segments) AS match_ratio FROM ("
        "SELECT h.*, h.similarity * h.scale_weight AS s, h.similarity * h.scale_weight * h.similarity * h.scale_weight * h.scale_weight AS w, "
        f"n.num_segments FROM {source} h JOIN (SELECT query_id, count(*) AS num_segments FROM {source} WHERE rank = 1 GROUP BY query_id) n "
        "USING (query_id)) GROUP BY query_id, cand_id"
    )


P.add("tempo", run_parts("tops", "tempo"))
P.add("votes", vote_parts("hits"))
P.add(
    "scores",
    "SELECT v.*, coalesce(t.temporal_score, 0.0) AS temporal_score, greatest(v.weighted_similarity, v.max_similarity) AS mean_similarity, "
    "(0.35 * coalesce(0.7 * v.weighted_similarity + 0.3 * v.geometric_similarity, v.weighted_similarity) "
    "+ 0.30 * pow(v.rank_1_count / v.num_segments, 1.5) + 0.15 * (v.rank_5_count / v.num_segments) "
    "+ 0.10 * v.match_ratio + 0.15 * pow(coalesce(t.temporal_score, 0.0), 1.2)) / 1.05 AS combined_score "
    "FROM votes v LEFT JOIN tempo t USING (query_id, cand_id)",
)
P.add(
    "cands",
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, mean_similarity DESC, cand_id) AS rank FROM scores",
)
P.add(
    "reranked",
    "SELECT * EXCLUDE (rank, a, sd, n, r1, scales), CASE WHEN a IS NULL THEN rank ELSE row_number() OVER (PARTITION BY query_id, a IS NULL "
    "ORDER BY rerank_score DESC, cand_id) END AS rank FROM (SELECT *, 0.35 * a + 0.25 * consistency_score + 0.20 * r1 / n + 0.10 * n / num_segments "
    "+ 0.10 * scale_consistency AS rerank_score FROM (SELECT c.*, s.a, s.sd, s.n, s.r1, s.scales, 1.0 / (1.0 + s.sd) AS consistency_score, "
    "CASE WHEN s.scales = 1 THEN 1.0 WHEN s.a > 0 THEN 1.0 - s.sd / s.a WHEN s.a IS NOT NULL THEN 0.0 END AS scale_consistency FROM cands c LEFT JOIN ("
    "SELECT h.query_id, h.cand_id, avg(similarity) AS a, stddev_pop(similarity) AS sd, count(*) AS n, count(*) FILTER (WHERE h.rank = 1) AS r1, "
    "count(DISTINCT scale) AS scales FROM hits h SEMI JOIN (SELECT query_id, cand_id FROM cands WHERE rank <= 5) t "
    "ON h.query_id = t.query_id AND h.cand_id = t.cand_id GROUP BY ALL) s USING (query_id, cand_id)))",
)
P.add(
    "quality",
    "SELECT *, 0.30 * rank_1_count / num_segments + 0.25 * match_count / num_segments + 0.25 * temporal_score "
    "+ 0.20 * least(combined_score, 1.0) AS quality_score FROM {src}".replace("{src}", "reranked"),
)
P.add(
    "confident",
    "SELECT * EXCLUDE (t, u, n), CASE WHEN n > 1 THEN coalesce(least(1.0, base + rerank_score * 0.1), base) ELSE 0.5 END AS confidence FROM ("
    "SELECT *, 0.25 * least((CASE WHEN t > 0 THEN (t - u) / t ELSE 0 END) * 2, 1.0) + 0.25 * rank_1_count / num_segments + 0.20 * temporal_score "
    "+ 0.15 * least(match_count / num_segments * 2, 1.0) + 0.15 * quality_score AS base FROM quality JOIN ("
    "SELECT query_id, max(combined_score) FILTER (WHERE rank = 1) AS t, max(combined_score) FILTER (WHERE rank = 2) AS u, count(*) AS n "
    "FROM quality GROUP BY query_id) USING (query_id))",
)
P.add(
    "final",
    "SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY confidence * combined_score DESC, combined_score DESC, cand_id) AS rank FROM confident",
)
P.add(
    "summary",
    "SELECT t.query_id, t.track_id, t.transform_type, t.severity, l.latency_ms, c.cand_id AS top_match_id, coalesce(c.own_similarity, 0.0) AS top_match_similarity, "
    "coalesce(c.rank, -1) AS top_match_rank FROM truth t JOIN lat l USING (query_id) LEFT JOIN (SELECT * FROM cands WHERE rank = 1) c USING (query_id)",
)
P.add(
    "judged",
    "SELECT s.*, coalesce(s.top_match_id = s.track_id, false) AS correct, c.rank AS true_rank FROM summary s "
    "LEFT JOIN cands c ON c.query_id = s.query_id AND c.cand_id = s.track_id",
)
