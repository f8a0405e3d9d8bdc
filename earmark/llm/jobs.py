"""Helpers of the jobs in this subpackage: partition counts, batch sizes, tables written once."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from earmark.llm.words import chunks
from earmark.session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "shared_folder", "bound_batches", "input_bytes", "deal", "take_columns", "with_measures"]

BATCH_BYTES = 16 << 20
# Bytes of a shuffle partition, about.
PARTITION_BYTES = 64 << 20
UNKNOWN = 1 << 50


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once for an application.

    So the tasks need no installed copy, and run the driver's version of it.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="earmark-package-")) / "earmark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at 16 MB, so that very long texts don't pile up in one batch.

    A smaller limit that the session already has stays. The tasks get this package as well.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of `df`, used to choose partition counts only."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), UNKNOWN)


def deal(df: DataFrame, *keys: str, expected: int = 0) -> DataFrame:
    """Shuffle by keys, without merging partitions.

    There are as many as the session asks for, or more where `expected` bytes need them. Spark gives
    `UNKNOWN` bytes or more for tables whose size it can't tell; these ask for none.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n if expected >= UNKNOWN else max(n, min(expected // PARTITION_BYTES, 1 << 20)), *keys)


def take_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under inner names; other columns can't clash with those of an operator."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def with_measures(documents: DataFrame, text: str, names: list[str], measure: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], **limit: int) -> DataFrame:
    """The rows of `documents` as they are, with whole numbers measured on each text beside them.

    `measure` takes the bytes of some texts and their offsets. Rows need no key, and none is told from
    its id. `limit` is that of `chunks`.
    """
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, text, **limit):
                added = [pa.array(np.asarray(v).astype(np.int64)) for v in measure(data, offsets)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *names])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, *[StructField(n, LongType()) for n in names]]))
