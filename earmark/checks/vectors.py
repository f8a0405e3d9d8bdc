"""Registered queries for vector search and index tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from earmark import fixtures as X
from earmark.checks.matching_sql import P, unit
from earmark.checks.support import Query, r6, tidy
from earmark.functions.columns import index_of_segment, segment_id, track_of_segment
from earmark.operators import cells as C
from earmark.operators import slots as S
from earmark.operators import vectors as V
from earmark.session import shared_folder

K = 10
PROBES = 3
TABLES, WIDTH, BUCKET = 4, 2, 0.25
INDEX_CONFIG = {"index_type": "flat", "metric": "cosine", "normalize": True}
MODEL_CONFIG = {"embedding_dim": 64, "sample_rate": 44100, "segment_length": 10.0}
PROJECTIONS = V.random_projections(64, TABLES, WIDTH)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql:
            ORACLES[name] = P.sql(sql)
        return fn

    return wrap


def _single(spark, sf):
    return X.masked(spark, sf).select("query_id", "segment_idx", "vector")


def _named(spark, sf):
    return X.segments(spark, sf).select(segment_id(F.col("track_id"), F.col("segment_idx")).alias("cand_id"), "vector")


@register(
    "l2_normalize",
    f"SELECT cand_id, d, {r6('v[d]')} AS x FROM (SELECT cand_id, {unit('w')} AS v, unnest(range(1, 65)) AS d FROM ("
    "SELECT cand_id, list_transform(vector, lambda x: x * (length(cand_id) - 5)) AS w FROM cat))",
)
def l2_normalize(spark, sf):
    stretched = X.corpus(spark, sf).withColumn("vector", F.transform("vector", lambda x: x * (F.length("cand_id") - 5)))
    return V.l2_normalize(stretched).select("cand_id", F.posexplode("vector").alias("d", "x")).withColumn("d", F.col("d") + 1)


@register("knn_cosine", f"SELECT query_id, scale, segment_idx, cand_id, rank, {r6('similarity')} AS similarity FROM seg_hits")
def knn_cosine(spark, sf):
    return V.knn_cosine(X.queries(spark, sf), X.corpus(spark, sf), K).drop("scale_weight")


@register(
    "knn_ip",
    f"SELECT query_id, segment_idx, cand_id, rank, {r6('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY s DESC, cand_id) AS rank "
    f"FROM (SELECT m.query_id, m.segment_idx, c.cand_id, (round((list_dot_product(m.vector, c.vector)) * 1073741824) / 1073741824) AS s FROM mask m, cat c)) WHERE rank <= {K}",
)
def knn_ip(spark, sf):
    return V.knn_ip(_single(spark, sf), X.corpus(spark, sf), K)


_L2 = (
    f"SELECT query_id, segment_idx, cand_id, rank, {r6('d')} AS distance, {r6('1.0 / (1.0 + d)')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY d, cand_id) AS rank "
    "FROM (SELECT m.query_id, m.segment_idx, c.cand_id, (round((list_dot_product(m.vector, m.vector) + list_dot_product(c.vector, c.vector) - 2 * list_dot_product(m.vector, c.vector)) * 1073741824) / 1073741824) AS d "
    f"FROM mask m, cat c)) WHERE rank <= {K}"
)


@register("knn_l2", _L2)
def knn_l2(spark, sf):
    return V.knn_l2(_single(spark, sf), X.corpus(spark, sf), K)


@register("knn_l2_blocked", _L2)
def knn_l2_blocked(spark, sf):
    """The way taken when the queries are too many to broadcast."""
    return V.knn_l2(_single(spark, sf), X.corpus(spark, sf), K, broadcast_bytes=0, block_rows=256)


P.add(
    "cells",
    "SELECT label AS cell_id, list(x ORDER BY d) AS vector FROM (SELECT label, d, avg(CAST(embedding[d] AS DOUBLE)) AS x FROM "
    "(SELECT label, embedding, unnest(range(1, 65)) AS d FROM embeddings) GROUP BY label, d) GROUP BY label",
)
_near = (
    "SELECT {key}, cell_id FROM (SELECT {key}, cell_id, row_number() OVER (PARTITION BY {key} ORDER BY (round(("
    "list_dot_product(v.vector, v.vector) + list_dot_product(c.vector, c.vector) - 2 * list_dot_product(v.vector, c.vector)) * 1073741824) / 1073741824), cell_id) AS r "
    "FROM {table} v, cells c) WHERE r <= {n}"
)
P.add("cat_cell", _near.format(key="cand_id", table="cat", n=1).replace("cell_id, row", "c.cell_id, row"))
P.add("uq", f"SELECT query_id, segment_idx, {unit('vector')} AS vector FROM mask")
P.add("q_cell", _near.format(key="query_id, segment_idx", table="uq", n=PROBES))


_IVF = (
    f"SELECT query_id, segment_idx, cand_id, rank, {r6('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY s DESC, cand_id) AS rank FROM ("
    "SELECT q.query_id, q.segment_idx, c.cand_id, (round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) AS s FROM uq q JOIN q_cell USING (query_id, segment_idx) "
    f"JOIN cat_cell x USING (cell_id) JOIN cat c ON c.cand_id = x.cand_id)) WHERE rank <= {K}"
)


@register("ivf_search", _IVF)
def ivf_search(spark, sf):
    return V.ivf_search(_single(spark, sf), X.corpus(spark, sf), K, PROBES, X.label_centroids(spark, sf))


_COSINE = (
    f"SELECT query_id, segment_idx, cand_id, rank, {r6('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY s DESC, cand_id) AS rank "
    "FROM (SELECT q.query_id, q.segment_idx, c.cand_id, (round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) AS s FROM uq q, cat c)) "
    f"WHERE rank <= {K}"
)


@register("ivf_search_trained", _COSINE)
def ivf_search_trained(spark, sf):
    """Trained cells, all of them probed: the exact result, whatever the training came to."""
    return V.ivf_search(_single(spark, sf), X.corpus(spark, sf), K, 16, nlist=16)


@register("ivf_search_stored", _IVF)
def ivf_search_stored(spark, sf):
    """Build, write, read and search an index; the stored centroids choose the probes."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    V.write_index(V.build_index(_named(spark, sf), {**INDEX_CONFIG, "index_type": "ivf"}, X.label_centroids(spark, sf)), path)
    stored = V.read_index(spark, path)
    return V.ivf_search(_single(spark, sf), stored.table, K, PROBES, stored.centroids)


@register("ivf_search_exact", _COSINE)
def ivf_search_exact(spark, sf):
    """Cells by their bounds, without a number of probes: the result of `knn_cosine`."""
    return V.ivf_search(_single(spark, sf), X.corpus(spark, sf), K, centroids=X.label_centroids(spark, sf))


@register("ivf_search_exact_blocked", _COSINE)
def ivf_search_exact_blocked(spark, sf):
    """The same when the queries are too many to go to every task."""
    return C.search_cells(_single(spark, sf), X.corpus(spark, sf), K, X.label_centroids(spark, sf), broadcast_bytes=0, block_rows=512).hits


@register("ivf_search_exact_l2", _L2)
def ivf_search_exact_l2(spark, sf):
    found = V.ivf_search(_single(spark, sf), X.corpus(spark, sf), K, centroids=X.label_centroids(spark, sf), metric="l2")
    return found.select("query_id", "segment_idx", "cand_id", "rank", "distance", "similarity")


@register("ivf_search_exact_stored", _COSINE)
def ivf_search_exact_stored(spark, sf):
    """Built from half of the corpus, then brought up to date: the radii still bound all members."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    V.write_index(_known(spark, sf), path)
    V.append_to_index(spark, path, _named(spark, sf))
    stored = V.read_index(spark, path)
    return V.ivf_search(_single(spark, sf), stored.table, K, centroids=stored.centroids)


@register("knn_cosine_shared_floor", _COSINE)
def knn_cosine_shared_floor(spark, sf):
    """Tasks prune by floors from a sample, and their hits are merged in groups first."""
    return V.knn_cosine(_single(spark, sf), X.corpus(spark, sf).repartition(16, "cand_id"), K, shared_floor=True, floor_rows=100)


@register(
    "knn_cosine_depths",
    f"SELECT query_id, segment_idx, depth, cand_id, rank, {r6('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY s DESC, cand_id) AS rank "
    "FROM (SELECT q.query_id, q.segment_idx, q.segment_idx * 3 AS depth, c.cand_id, (round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) AS s FROM uq q, cat c)) "
    "WHERE rank <= depth",
)
def knn_cosine_depths(spark, sf):
    """Each query row is searched to a depth of its own; the first segment to none."""
    rows = _single(spark, sf).withColumn("depth", F.col("segment_idx") * 3)
    return V.knn_cosine(rows, X.corpus(spark, sf), "depth")


# Queries whose rows share their keys: each row keeps its own best.
P.add("sk", "SELECT *, segment_idx % 2 AS part FROM uq")
_REPEATED = (
    f"SELECT query_id, part, cand_id, rank, {r6('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY s DESC, cand_id) AS rank FROM ("
    "SELECT q.query_id, q.segment_idx, q.part, c.cand_id, (round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) AS s FROM sk q, cat c)) "
    "WHERE rank <= 3"
)


def _repeated(spark, sf, **options):
    rows = _single(spark, sf).select("query_id", (F.col("segment_idx") % 2).alias("part"), "vector")
    return V.knn_cosine(rows, X.corpus(spark, sf), 3, **options)


@register("knn_cosine_repeated_keys", _REPEATED)
def knn_cosine_repeated_keys(spark, sf):
    """Small query set, sent to every task."""
    return _repeated(spark, sf)


@register("knn_cosine_repeated_keys_corpus", _REPEATED)
def knn_cosine_repeated_keys_corpus(spark, sf):
    """More queries than may be sent, so the corpus is."""
    n = X.corpus(spark, sf).count()
    return _repeated(spark, sf, broadcast_bytes=n * 64 * 8)


@register("knn_cosine_repeated_keys_blocked", _REPEATED)
def knn_cosine_repeated_keys_blocked(spark, sf):
    """Neither side may be sent."""
    return _repeated(spark, sf, broadcast_bytes=0, block_rows=512)


def _slots(vector: str, probes: int = 1) -> str:
    """Slots of a vector in all tables: the cell along each direction, and for probes the nearest neighbours."""
    parts = []
    for i, table in enumerate(PROJECTIONS):
        along = [f"list_dot_product({vector}, [{', '.join(map(str, d))}]::DOUBLE[]) / {BUCKET}" for d in table]
        name = lambda moved, i=i, along=along: f"'{i}:' || " + " || ',' || ".join(f"CAST(floor({x}) + {moved.get(j, 0)} AS BIGINT)" for j, x in enumerate(along))
        near = [f"{{'d': -1.0::DOUBLE, 'slot': {name({})}}}"]
        for j, x in enumerate(along):
            near += [f"{{'d': {x} - floor({x}), 'slot': {name({j: -1})}}}", f"{{'d': 1 - ({x} - floor({x})), 'slot': {name({j: 1})}}}"]
        parts.append(f"list_sort([{', '.join(near)}])[1:{probes}]" if probes > 1 else f"[{near[0]}]")
    return f"unnest([p.slot FOR p IN flatten([{', '.join(parts)}])])"


P.add("q_slot", f"SELECT query_id, segment_idx, vector, {_slots('vector')} AS slot FROM uq")
P.add("c_slot", f"SELECT cand_id, vector, {_slots('vector')} AS slot FROM cat")


P.add("q_probe", f"SELECT query_id, segment_idx, vector, {_slots('vector', 3)} AS slot FROM uq")


def _ann_sql(slots: str) -> str:
    return (
        f"SELECT query_id, segment_idx, cand_id, rank, {r6('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY s DESC, cand_id) AS rank FROM ("
        f"SELECT q.query_id, q.segment_idx, c.cand_id, max((round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824)) AS s FROM {slots} q JOIN c_slot c USING (slot) GROUP BY ALL)) "
        f"WHERE rank <= {K}"
    )


@register("ann_search", _ann_sql("q_slot"))
def ann_search(spark, sf):
    return V.ann_search(_single(spark, sf), X.corpus(spark, sf), K, PROJECTIONS, BUCKET)


@register("ann_search_probes", _ann_sql("q_probe"))
def ann_search_probes(spark, sf):
    """Each query looks into three cells of each table."""
    return V.ann_search(_single(spark, sf), X.corpus(spark, sf), K, PROJECTIONS, BUCKET, probes=3)


@register(
    "slot_pairs",
    "SELECT CAST(split_part(slot, ':', 1) AS INTEGER) AS \"table\", count(*) AS slots, CAST(sum(q.n * c.n) AS BIGINT) AS pairs, max(q.n * c.n) AS largest "
    "FROM (SELECT slot, count(*) AS n FROM q_probe GROUP BY slot) q JOIN (SELECT slot, count(*) AS n FROM c_slot GROUP BY slot) c USING (slot) GROUP BY ALL",
)
def slot_pairs(spark, sf):
    return S.slot_pairs(_single(spark, sf), X.corpus(spark, sf), PROJECTIONS, BUCKET, probes=3)


@register(
    "build_index",
    f"SELECT cand_id, split_part(cand_id, '_seg_', 1) AS track_id, len(vector) AS dimension, {r6('list_dot_product(vector, vector)')} AS squared_norm, "
    f"{r6('vector[1]')} AS x1, {r6('vector[64]')} AS x64, cell_id FROM cat JOIN cat_cell USING (cand_id)",
)
def build_index(spark, sf):
    table, *_ = V.build_index(_named(spark, sf), {**INDEX_CONFIG, "index_type": "ivf"}, X.label_centroids(spark, sf))
    v = F.col("vector")
    return table.select(
        "cand_id", "track_id", F.size(v).alias("dimension"), V.dot(v, v).alias("squared_norm"), v[0].alias("x1"), v[63].alias("x64"), "cell_id"
    )


@register(
    "build_index_meta",
    "SELECT count(*) AS num_vectors, max(len(embedding)) AS dimension, 'flat' AS index_type, 'cosine' AS metric, "
    """'{"index_type": "flat", "metric": "cosine", "normalize": true}' AS config FROM embeddings""",
)
def build_index_meta(spark, sf):
    return V.build_index(_named(spark, sf), INDEX_CONFIG).meta


P.add("neg", "SELECT cand_id, list_transform(vector, lambda x: -x) AS vector FROM cat")
P.add("neg_cell", _near.format(key="cand_id", table="neg", n=1).replace("cell_id, row", "c.cell_id, row"))
P.add("half", "SELECT DISTINCT 'track' || (vec_id // 5) AS track_id FROM embeddings WHERE label = 0")


def _known(spark, sf):
    """An index in cells that holds the tracks with a segment of label 0."""
    some = X.table(spark, sf, "embeddings").where("label = 0").select(F.concat(F.lit("track"), F.expr("vec_id div 5")).alias("track_id")).distinct()
    rows = X.segments(spark, sf).join(some, "track_id", "left_semi").select(segment_id(F.col("track_id"), F.col("segment_idx")).alias("cand_id"), "vector")
    return V.build_index(rows, {**INDEX_CONFIG, "index_type": "ivf"}, X.label_centroids(spark, sf))


@register(
    "update_index",
    f"SELECT cand_id, split_part(cand_id, '_seg_', 1) AS track_id, cell_id, {r6('list_dot_product(vector, vector)')} AS squared_norm "
    "FROM cat JOIN cat_cell USING (cand_id) WHERE split_part(cand_id, '_seg_', 1) NOT IN (SELECT track_id FROM half)",
)
def update_index(spark, sf):
    fresh = V.update_index(_known(spark, sf), _named(spark, sf))[0]
    return fresh.select("cand_id", "track_id", "cell_id", V.dot(F.col("vector"), F.col("vector")).alias("squared_norm"))


@register(
    "update_index_counts",
    "SELECT count(DISTINCT t) FILTER (WHERE k IS NULL) AS added_tracks, count(DISTINCT t) FILTER (WHERE k IS NOT NULL) AS skipped_tracks, "
    "count(*) FILTER (WHERE k IS NULL) AS added_vectors, count(*) FILTER (WHERE k IS NOT NULL) AS skipped_vectors "
    "FROM (SELECT split_part(cand_id, '_seg_', 1) AS t, h.track_id AS k FROM cat LEFT JOIN half h ON h.track_id = split_part(cand_id, '_seg_', 1))",
)
def update_index_counts(spark, sf):
    return V.update_index(_known(spark, sf), _named(spark, sf))[1]


@register(
    "update_index_changed",
    f"SELECT cand_id, track_id, cell_id, {r6('vector[1]')} AS x1, changed FROM (SELECT c.cand_id, split_part(c.cand_id, '_seg_', 1) AS track_id, x.cell_id, "
    "CASE WHEN c.cand_id LIKE '%_seg_0001' THEN n.vector ELSE c.vector END AS vector, c.cand_id LIKE '%_seg_0001' AS changed FROM cat c JOIN neg n USING (cand_id) "
    "JOIN (SELECT cand_id, cell_id FROM cat_cell WHERE cand_id NOT LIKE '%_seg_0001' UNION ALL SELECT cand_id, cell_id FROM neg_cell WHERE cand_id LIKE '%_seg_0001') x USING (cand_id))",
)
def update_index_changed(spark, sf):
    """An index of some tracks takes in all of them, with one changed segment each; the changed ones replace the old."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    V.write_index(_known(spark, sf), path)
    changed = F.col("cand_id").endswith("_seg_0001")
    turned = _named(spark, sf).withColumn("vector", F.when(changed, F.transform("vector", lambda x: -x)).otherwise(F.col("vector")))
    V.append_to_index(spark, path, turned)
    table = V.read_index(spark, path).table
    return table.select("cand_id", "track_id", "cell_id", F.col("vector")[0].alias("x1"), changed.alias("changed"))


@register(
    "segment_id",
    "SELECT track_id, segment_idx, cand_id, split_part(cand_id, '_seg_', 1) AS parsed_track, CAST(split_part(cand_id, '_seg_', 2) AS BIGINT) AS parsed_idx FROM ("
    "SELECT 'track' || vec_id AS track_id, vec_id * 7 AS segment_idx, 'track' || vec_id || '_seg_' || CASE WHEN vec_id * 7 < 10000 THEN lpad(CAST(vec_id * 7 AS VARCHAR), 4, '0') ELSE CAST(vec_id * 7 AS VARCHAR) END AS cand_id FROM embeddings)",
)
def segment_ids(spark, sf):
    rows = X.table(spark, sf, "embeddings").select(F.concat(F.lit("track"), F.col("vec_id").cast("string")).alias("track_id"), (F.col("vec_id") * 7).alias("segment_idx"))
    named = rows.withColumn("cand_id", segment_id(F.col("track_id"), F.col("segment_idx")))
    return named.withColumns({"parsed_track": track_of_segment(F.col("cand_id")), "parsed_idx": index_of_segment(F.col("cand_id"))})


_model = V.model_hash(MODEL_CONFIG)
P.add(
    "cache_rows",
    f"SELECT 'track' || doc_id AS track_id, lang, source, 'track' || doc_id || '_' || substr(md5(text), 1, 12) || '_{_model}' AS cache_key, "
    f"'track' || doc_id || '_' || substr(md5(text || CASE WHEN source = 'src1' THEN ' edited' ELSE '' END), 1, 12) || '_{_model}' AS stored_key FROM documents",
)


def _cache(spark, sf):
    """Keys of all documents, and a cache of the English ones in which those of one source are stale."""
    docs = X.table(spark, sf, "documents").select(F.concat(F.lit("track"), F.col("doc_id").cast("string")).alias("track_id"), "text", "lang", "source")
    keyed = V.cache_keys(docs, "text", MODEL_CONFIG).select("track_id", "cache_key")
    older = docs.where("lang = 'en'").withColumn("text", F.when(F.col("source") == "src1", F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return keyed, V.cache_keys(older, "text", MODEL_CONFIG).select("track_id", "cache_key", "source")


@register("embedding_cache", "SELECT track_id, cache_key, CASE WHEN lang = 'en' AND stored_key = cache_key THEN 'hit' ELSE 'miss' END AS outcome FROM cache_rows")
def embedding_cache(spark, sf):
    keyed, cache = _cache(spark, sf)
    found, missing = V.cache_lookup(keyed, cache)
    return found.withColumn("outcome", F.lit("hit")).unionByName(missing.withColumn("outcome", F.lit("miss"))).select("track_id", "cache_key", "outcome")


@register("embedding_cache_invalidate", "SELECT track_id, stored_key AS cache_key FROM cache_rows WHERE lang = 'en' AND stored_key = cache_key")
def embedding_cache_invalidate(spark, sf):
    keyed, cache = _cache(spark, sf)
    return V.cache_invalidate(cache, keyed).select("track_id", "cache_key")


@register(
    "embedding_cache_evict",
    "SELECT track_id, stored_key AS cache_key FROM cache_rows WHERE lang = 'en' AND source <> 'src2'",
)
def embedding_cache_evict(spark, sf):
    _, cache = _cache(spark, sf)
    return V.cache_evict(cache, cache.where("source = 'src2'")).select("track_id", "cache_key")


@register(
    "embedding_cache_stats",
    "SELECT count(DISTINCT track_id) AS entries, count(*) AS segments, sum(len(vector) * 4)::BIGINT AS bytes FROM seg",
)
def embedding_cache_stats(spark, sf):
    return V.cache_stats(X.segments(spark, sf).withColumnRenamed("track_id", "cache_key"))


P.add(
    "pair_sims",
    "SELECT t.query_id, t.track_id, q.segment_idx AS qs, s.segment_idx AS ts, (round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) + 0.0 AS s FROM truth t JOIN uq q USING (query_id) "
    "JOIN seg s ON s.track_id = t.track_id JOIN cat c ON c.cand_id = s.track_id || '_seg_' || lpad(CAST(s.segment_idx AS VARCHAR), 4, '0')",
)


@register(
    "pair_similarity_matrix",
    f"SELECT query_id, track_id, n AS pairs, {r6('mx')} AS max_similarity, {r6('mean')} AS mean_similarity, {r6('p95')} AS p95_similarity, {r6('top')} AS weighted_top_similarity, "
    f"best[1] AS best_query_segment, best[2] AS best_track_segment, {r6('mean')} AS verdict_mean, {r6('greatest(mx, top, p95)')} AS verdict_max FROM ("
    "SELECT query_id, track_id, max(n) AS n, max(s) AS mx, avg(s) AS mean, quantile_cont(s, 0.95) AS p95, "
    "sum(exp(2 * s) * s) FILTER (WHERE place <= greatest(1, trunc(n * 0.2))) / sum(exp(2 * s)) FILTER (WHERE place <= greatest(1, trunc(n * 0.2))) AS top, "
    "max([qs, ts]) FILTER (WHERE place = 1) AS best FROM (SELECT *, count(*) OVER (PARTITION BY query_id, track_id) AS n, "
    "row_number() OVER (PARTITION BY query_id, track_id ORDER BY s DESC, qs, ts) AS place FROM pair_sims) GROUP BY query_id, track_id)",
)
def pair_similarity_matrix(spark, sf):
    tracks = V.l2_normalize(X.segments(spark, sf))
    return V.pair_similarity_matrix(X.truth(spark, sf), V.l2_normalize(_single(spark, sf)), tracks)


P.add("allowed", "SELECT DISTINCT 'track' || (vec_id // 5) AS track_id FROM embeddings WHERE label = 3")


@register(
    "restricted_search",
    f"SELECT query_id, track_id, {r6('max(s)')} AS similarity, arg_min(cand_id, (-s, cand_id)) AS cand_id, min(rank) AS rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id, segment_idx ORDER BY s DESC, cand_id) AS rank FROM (SELECT q.query_id, q.segment_idx, c.cand_id, split_part(c.cand_id, '_seg_', 1) AS track_id, "
    f"(round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) AS s FROM uq q, cat c WHERE split_part(c.cand_id, '_seg_', 1) IN (SELECT track_id FROM allowed))) WHERE rank <= {K} GROUP BY query_id, track_id",
)
def restricted_search(spark, sf):
    allow = X.table(spark, sf, "embeddings").where("label = 3").select(F.concat(F.lit("track"), F.expr("vec_id div 5")).alias("track_id"))
    return V.restricted_search(_single(spark, sf), X.corpus(spark, sf), allow, K)


@register(
    "pool_vectors",
    f"SELECT track_id, d, {r6('avg(vector[d])')} AS x FROM (SELECT track_id, vector, unnest(range(1, 65)) AS d FROM seg) GROUP BY track_id, d",
)
def pool_vectors(spark, sf):
    pooled = V.pool_vectors(X.segments(spark, sf))
    return pooled.select("track_id", F.posexplode("vector").alias("d", "x")).withColumn("d", F.col("d") + 1)


@register(
    "pool_vectors_windows",
    f"SELECT width, track_id, window_idx, d, {r6('avg(vector[d])')} AS x FROM (SELECT w.width, s.track_id, w.start AS window_idx, s.vector, unnest(range(1, 65)) AS d FROM seg s "
    "JOIN (VALUES (2, 0), (2, 1), (2, 2), (2, 3), (4, 0)) w(width, start) ON s.segment_idx BETWEEN w.start AND w.start + w.width - 1) GROUP BY ALL",
)
def pool_vectors_windows(spark, sf):
    parts = [V.pool_vectors(X.segments(spark, sf), w, s).withColumn("width", F.lit(w)) for w, s in ((2, 1), (4, 2))]
    both = parts[0].unionByName(parts[1])
    return both.select("width", "track_id", "window_idx", F.posexplode("vector").alias("d", "x")).withColumn("d", F.col("d") + 1)


_mean = "SELECT {key}, list(x ORDER BY d) AS vector FROM (SELECT {key}, d, avg(vector[d]) AS x FROM (SELECT {key}, vector, unnest(range(1, 65)) AS d FROM {table}) GROUP BY {key}, d) GROUP BY {key}"
P.add("q_mean", _mean.format(key="query_id", table="mask"))
P.add("t_mean", _mean.format(key="track_id", table="seg"))
P.add("uq_mean", f"SELECT query_id, {unit('vector')} AS vector FROM q_mean")


def _verdict_sql(limit: float) -> str:
    return (
        f"SELECT t.query_id, t.track_id, (f.rank IS NOT NULL OR d > {limit}) AS matched, {r6('greatest(f.s, d)')} AS similarity, {r6('d')} AS direct_similarity, f.rank FROM ("
        "SELECT t.query_id, t.track_id, list_dot_product(q.vector, m.vector) AS d FROM truth t JOIN q_mean q USING (query_id) JOIN t_mean m USING (track_id)) t LEFT JOIN ("
        "SELECT query_id, track_id, min(rank) AS rank, max(s) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cand_id) AS rank FROM ("
        "SELECT q.query_id, c.cand_id, split_part(c.cand_id, '_seg_', 1) AS track_id, (round((list_dot_product(q.vector, c.vector)) * 1073741824) / 1073741824) AS s FROM uq_mean q, cat c)) "
        f"WHERE rank <= {K} GROUP BY query_id, track_id) f USING (query_id, track_id)"
    )


def _verdict(spark, sf, sample_mode):
    q = V.pool_vectors(_single(spark, sf).withColumnRenamed("query_id", "track_id")).withColumnRenamed("track_id", "query_id")
    found = V.knn_cosine(q, X.corpus(spark, sf), K)
    return V.pair_match_verdict(X.truth(spark, sf), found, q, V.pool_vectors(X.segments(spark, sf)), sample_mode)


@register("pair_match_verdict", _verdict_sql(0.7))
def pair_match_verdict(spark, sf):
    return _verdict(spark, sf, False)


@register("pair_match_verdict_sample", _verdict_sql(0.5))
def pair_match_verdict_sample(spark, sf):
    return _verdict(spark, sf, True)


@register(
    "best_rank_over_views",
    f"SELECT query_id, track_id, best[1]::BIGINT AS best_rank, {r6('-best[2]')} AS similarity, CASE WHEN best[3] = 1 THEN 'pair' ELSE 'single' END AS view FROM ("
    "SELECT h.query_id, t.track_id, min([h.rank::DOUBLE, -h.similarity, CASE WHEN h.scale = 2000 THEN 1 ELSE 2 END]) AS best FROM seg_hits h JOIN truth t ON t.query_id = h.query_id AND t.track_id = split_part(h.cand_id, '_seg_', 1) GROUP BY ALL)",
)
def best_rank_over_views(spark, sf):
    views = X.segment_hits(spark, sf).withColumn("view", F.when(F.col("scale") == 2000, "pair").otherwise("single"))
    return V.best_rank_over_views(X.truth(spark, sf), views)
