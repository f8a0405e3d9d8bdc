"""The whole chain from samples to a judged run, in stages that are skipped when they are done.

A stage is known by its name, its settings and the keys of the stages it reads; a source by a digest of
its rows. So a second run reads what the first wrote, and a changed setting or source runs again only what
depends on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.functions.columns import segment_id
from earmark.operators import evaluate as E
from earmark.operators import fusion as Q
from earmark.operators import signal as A
from earmark.operators import vectors as V
from earmark.operators.cells import measure_cells

_LEDGER = "name string, key string, settings string, inputs array<string>, at timestamp"


def table_digest(df: DataFrame) -> str:
    """Digest of the rows and columns of a table, whatever their order; repeated rows count."""
    def plain(f: T.StructField):
        return F.to_json(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    row = F.xxhash64(*[plain(f) for f in fields])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).alias("sum"), F.bit_xor(row).alias("xor")).first()
    schema = [(f.name, f.dataType.simpleString()) for f in fields]
    return hashlib.md5(json.dumps([schema, r.n, str(r["sum"]), r.xor]).encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    """A finished stage: its key and its table."""

    key: str
    table: DataFrame


class Stages:
    """Stages below a folder that all executors share, with a ledger of those that are finished.

    A stage's table is written first and its ledger row last, so a stage that was stopped runs anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ran: list[str] = []
        try:
            self.done = {r.key for r in self.ledger().select("key").collect()}
        except Exception as e:  # the folder is not there before the first stage
            if "PATH_NOT_FOUND" not in str(e):
                raise
            self.done = set()

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(_LEDGER).json(f"{self.path}/ledger")

    def source(self, table: DataFrame) -> Stage:
        return Stage(table_digest(table), table)

    def run(self, name: str, make: Callable[..., DataFrame], *inputs: Stage, **settings: object) -> Stage:
        """The table of `make(*tables, **settings)`, from the folder if a stage with these settings and inputs is finished."""
        told = json.dumps([name, settings, [s.key for s in inputs]], sort_keys=True, default=str)
        key = hashlib.md5(told.encode()).hexdigest()
        where = f"{self.path}/{name}/{key}"
        if key not in self.done:
            make(*[s.table for s in inputs], **settings).write.mode("overwrite").parquet(where)
            row = [(name, key, json.dumps(settings, sort_keys=True, default=str), [s.key for s in inputs])]
            made = self.spark.createDataFrame(row, "name string, key string, settings string, inputs array<string>")
            made.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.path}/ledger")
            self.done.add(key)
            self.ran.append(name)
        return Stage(key, self.spark.read.parquet(where))


@dataclass(frozen=True)
class ChainConfig:
    """Settings of `run_chain`; each is one of the stages it concerns."""

    length_sec: float = 5.0
    overlap: float = 0.5
    dim: int = 64
    sample_rate: int = A.SAMPLE_RATE
    frame: int = A.FRAME
    nlist: int | None = None
    k: int = 20
    threshold: float = 0.2


def _catalogue(samples: DataFrame, **shape: object) -> DataFrame:
    found = A.spectral_features(samples, **shape)
    return found.select(segment_id(F.col("track_id").cast("string"), F.col("segment_idx")).alias("cand_id"), "vector")


def _queries(samples: DataFrame, length_sec: float, **shape: object) -> DataFrame:
    found = A.spectral_features(samples, length_sec, **shape)
    scale = F.lit(round(1000 * length_sec))
    return found.select(F.col("track_id").cast("string").alias("query_id"), scale.alias("scale"), F.lit(1.0).alias("scale_weight"), "segment_idx", "vector")


def _hits(queries: DataFrame, placed: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    return Q.to_track_grain(V.ivf_search(queries, placed, k, centroids=cells))


def run_chain(spark: SparkSession, path: str, catalogue: DataFrame, asked: DataFrame, truth: DataFrame, config: ChainConfig = ChainConfig()) -> tuple[Mapping[str, Stage], list[str]]:
    """All stages from `catalogue` and `asked`, both `samples(track_id, idx, value)`, and the names of those that ran.

    `asked` has the query's id as its track_id; `truth(query_id, track_id, transform_type, severity, latency_ms)`.
    """
    stages = Stages(spark, path)
    shape = {"length_sec": config.length_sec, "overlap": config.overlap, "dim": config.dim, "sample_rate": config.sample_rate, "frame": config.frame}
    out = {"catalogue": stages.source(catalogue), "asked": stages.source(asked), "truth": stages.source(truth)}
    out["vectors"] = stages.run("vectors", _catalogue, out["catalogue"], **shape)
    out["centroids"] = stages.run("centroids", lambda v, nlist: V.train_cells(v, nlist), out["vectors"], nlist=config.nlist)
    out["placed"] = stages.run("placed", V.assign_cells, out["vectors"], out["centroids"])
    out["cells"] = stages.run("cells", measure_cells, out["placed"], out["centroids"])
    out["queries"] = stages.run("queries", _queries, out["asked"], **shape)
    out["hits"] = stages.run("hits", _hits, out["queries"], out["placed"], out["cells"], k=config.k)
    out["candidates"] = stages.run("candidates", lambda h, threshold: Q.fuse(h, Q.FusionConfig(threshold=threshold)), out["hits"], threshold=config.threshold)
    out["summary"] = stages.run("summary", lambda t, c: Q.top_match_summary(t, c), out["truth"], out["candidates"])
    out["metrics"] = stages.run("metrics", lambda c, s, t: E.metrics_by_group(c, s, t.drop("latency_ms")), out["candidates"], out["summary"], out["truth"])
    out["checks"] = stages.run("checks", E.pass_fail, out["metrics"])
    return out, stages.ran
