"""From vectors to a judged run: search, fusion, ranking, evaluation and stored results."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.functions import registry
from earmark.operators import evaluate as E
from earmark.operators import fusion as Q
from earmark.operators import vectors as V
from earmark.operators.distribution import join_hot
from earmark.plans import variants as T
from earmark.session import cut_lineage
from earmark.sources import sinks


@dataclass(frozen=True)
class MatchConfig:
    """How queries are searched and their votes are fused."""

    k: int = 20
    search: str = "exact"
    nprobe: int = 8
    nlist: int | None = None
    fusion: str = "votes"
    grain: str = "track"
    rrf_threshold: float = 0.2
    adjacent_weight: float = 0.15
    votes: Q.FusionConfig = field(default_factory=Q.FusionConfig)
    project_criteria: Mapping[str, object] = field(default_factory=dict)


def match(
    queries: DataFrame,
    corpus: DataFrame,
    config: MatchConfig = MatchConfig(),
    centroids: DataFrame | None = None,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Ranked candidates of every query.

    `queries(query_id, scale, scale_weight, segment_idx, vector)`, `corpus(cand_id, vector)`.
    """
    if config.search == "exact":
        hits = V.knn_cosine(queries, corpus, config.k)
    elif config.search == "cells":
        hits = V.ivf_search(queries, corpus, config.k, config.nprobe, centroids, config.nlist)
    else:
        raise ValueError(f"unknown search: {config.search}")
    hits = cut_lineage(Q.to_track_grain(hits) if config.grain == "track" else hits)
    if config.fusion == "votes":
        found = Q.fuse(hits, config.votes)
    elif config.fusion == "rrf":
        summed = Q.reciprocal_rank_fusion(hits, config.rrf_threshold)
        found = Q.adjacent_boost(summed, hits, config.adjacent_weight).withColumns(
            {"combined_score": F.col("score"), "mean_similarity": F.col("similarity")}
        )
    else:
        raise ValueError(f"unknown fusion: {config.fusion}")
    if projects is not None:
        found = Q.project_filter(found, projects, config.project_criteria)
    return found


# ---------------------------------------------------------------- settings by severity


class TwoRounds(NamedTuple):
    """Hits of both rounds with weights that sum to 1 over the scales of a query, the settings, and the queries searched again."""

    hits: DataFrame
    settings: DataFrame
    again: DataFrame


def severity_settings(variants: DataFrame, k: int, profile: str = "default") -> DataFrame:
    """`(query_id, transform_type, severity, k)`: how deep each query is searched at first, at least to `k`.

    `variants(query_id, transform_type)` may bring a `severity`, or a `path` that helps to tell it.
    """
    has = lambda c: F.col(c) if c in variants.columns else F.lit(None).cast("string")
    told = T.detect_severity(F.col("transform_type"), has("path"), profile)
    named = variants.select("query_id", "transform_type", F.coalesce(has("severity"), told).alias("severity"))
    return named.withColumn("k", F.greatest(F.lit(k), T.adaptive_topk(F.col("transform_type"), F.col("severity"))))


def search_by_severity(
    queries: DataFrame, corpus: DataFrame, variants: DataFrame, more_scales: Callable[[DataFrame], DataFrame], k: int = 20, profile: str = "default"
) -> TwoRounds:
    """Search each query as deep as its severity asks, and undecided queries again in more scales.

    A query is settled after the first round if a candidate leads clearly in one of its scales, or if its
    segments agree as its severity demands. For the others `more_scales(wanted)` makes the vectors
    `(query_id, scale, segment_idx, vector)` of the scales in `wanted(query_id, scale)`, and only these are
    searched, deeper than before. Scales that a query has already are not searched again.
    """
    settings = cut_lineage(severity_settings(variants, k, profile))
    # What is searched is read several times, and its vectors are shuffled once for that.
    deep = cut_lineage(join_hot(queries, settings.select("query_id", "k"), ["query_id"], F.col("segment_idx")).fillna(k, ["k"]))
    first = cut_lineage(Q.to_track_grain(V.knn_cosine(deep, corpus, "k").drop("k")))
    settled = Q.confident_match(first, by_scale=True).where("confident").select("query_id").distinct()
    decided = Q.scale_decision(first, settings, F.col("k"))
    again = cut_lineage(decided.where("needs_scales").join(settled, "query_id", "left_anti"))
    held = queries.select("query_id", "scale").distinct()
    wanted = again.select("query_id", "k", F.inline("extra_scales")).join(held, ["query_id", "scale"], "left_anti")
    wanted = cut_lineage(wanted.withColumnRenamed("weight", "scale_weight"))
    made = cut_lineage(join_hot(more_scales(wanted.select("query_id", "scale")), wanted, ["query_id", "scale"], F.col("segment_idx"), "inner"))
    second = cut_lineage(Q.to_track_grain(V.knn_cosine(made, corpus, "k").drop("k")))
    both = first.unionByName(second)
    weights = T.scale_weights(both.select("query_id", "scale", F.col("scale_weight").alias("weight")).distinct())
    hits = join_hot(both.drop("scale_weight"), weights.withColumnRenamed("weight", "scale_weight"), ["query_id", "scale"], F.col("segment_idx"), "inner")
    return TwoRounds(hits, settings, again)


def severity_thresholds(found: TwoRounds) -> DataFrame:
    """`(query_id, threshold)`: adapted to the mean top similarity, with the floor of the severity."""
    adapted = Q.adaptive_threshold(found.hits).join(found.settings.hint("merge"), "query_id")
    return T.severity_adjust(adapted.withColumns({"fusion_ratio": F.lit(1.0), "temporal_weight": F.lit(0.0)})).select("query_id", "threshold")


def match_by_severity(
    queries: DataFrame, corpus: DataFrame, variants: DataFrame, more_scales: Callable[[DataFrame], DataFrame],
    config: MatchConfig = MatchConfig(), profile: str = "default", gate: bool = False,
) -> DataFrame:
    """`match` with settings by severity: depth, threshold, scales and, with `gate`, the least similarity of a candidate.

    `variants` is described in `severity_settings`, the search in `search_by_severity`.
    """
    found = search_by_severity(queries, corpus, variants, more_scales, config.k, profile)
    found = found._replace(hits=cut_lineage(found.hits))
    candidates = Q.fuse(found.hits, replace(config.votes, threshold=cut_lineage(severity_thresholds(found))))
    return Q.similarity_gate(candidates, found.settings) if gate else candidates


@dataclass(frozen=True)
class Run:
    """Tables of a judged run."""

    candidates: DataFrame
    summary: DataFrame
    metrics: DataFrame
    checks: DataFrame
    status: DataFrame
    failures: DataFrame
    captured: DataFrame
    extra: dict[str, DataFrame]


def judge(candidates: DataFrame, queries: DataFrame, truth: DataFrame) -> Run:
    """Evaluate candidates. `queries(query_id, latency_ms)` names every query that was asked.

    `failures` has all of them; `captured` the first few of each transform with their candidates.
    """
    candidates = cut_lineage(candidates)
    named = queries.join(truth.select("query_id", "transform_type", "severity"), "query_id", "left")
    summary = cut_lineage(Q.top_match_summary(named, candidates))
    metrics = cut_lineage(E.metrics_by_group(candidates, summary, truth))
    checks = E.pass_fail(metrics)
    failed = E.failures(summary, truth)
    captured = E.failure_details(E.capture_failures(failed), candidates)
    extra = {name: fn(candidates, summary, truth) for name, fn in registry.metrics().items()}
    return Run(candidates, summary, metrics, checks, E.overall_status(checks), failed, captured, extra)


def store(run: Run, path: str, run_id: str, limit: int | None = None, phase: str = "unknown") -> None:
    """Write the tables of a run under its id, with all candidates or the first `limit` of each query.

    A run stored again replaces itself. Its `runs` record is what `read_runs` and `run_catalog` read.
    """
    sinks.write_results(
        path, run_id, summary=run.summary, stored=Q.store_limit(run.candidates, limit), metrics=run.metrics, suite=E.suite_summary(run.metrics)
    )
    sinks.write_json(run.failures, f"{path}/failures", run_id)
    sinks.write_json(run.captured, f"{path}/captured", run_id)
    sinks.write_csv(run.checks, f"{path}/checks", run_id)
    for name, table in run.extra.items():
        sinks.write_json(table, f"{path}/{name}", run_id)
    total = F.count(F.lit(1)).alias("total_queries")
    record = F.to_json(F.struct(F.struct(F.lit(phase).alias("phase"), F.col("total_queries")).alias("summary")))
    sinks.write_json(
        run.summary.agg(total).select(record.alias("metrics"), F.lit(True).alias("has_summary"), F.unix_timestamp().alias("modified")),
        f"{path}/runs", run_id,
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs stored below `path`, as `sources.manifest.run_catalog` takes them."""
    schema = "metrics string, has_summary boolean, modified bigint, run_id string"
    return spark.read.schema(schema).json(f"{path}/runs").select("run_id", "metrics", "has_summary", "modified")
