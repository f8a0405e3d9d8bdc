"""Writing results: query summary, stored candidates, metrics and suite summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.functions.columns import sanitize_floats


def _of_run(df: DataFrame, run_id: str):
    """A writer that replaces what the run wrote before and leaves other runs alone."""
    named = sanitize_floats(df).withColumn("run_id", F.lit(run_id))
    return named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")


def write_csv(df: DataFrame, path: str, run_id: str) -> None:
    """Flat table as CSV, one folder for each run; writing a run again replaces it."""
    _of_run(df, run_id).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, run_id: str) -> None:
    """One JSON record for each row, nested columns kept, one folder for each run; writing a run again replaces it."""
    _of_run(df, run_id).json(path)


def write_results(
    path: str,
    run_id: str,
    summary: DataFrame | None = None,
    stored: DataFrame | None = None,
    metrics: DataFrame | None = None,
    suite: DataFrame | None = None,
) -> None:
    """All results of a run. `stored` has the nested candidate list of each query."""
    if summary is not None:
        write_csv(summary, f"{path}/query_summary", run_id)
    if stored is not None:
        write_json(stored, f"{path}/query_results", run_id)
    if metrics is not None:
        write_json(metrics, f"{path}/metrics", run_id)
    if suite is not None:
        write_csv(suite, f"{path}/suite_summary", run_id)
