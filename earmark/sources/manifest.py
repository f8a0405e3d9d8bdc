"""Manifests: reading, checking and completing the catalogue of tracks, and linking projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.functions.columns import blank_to_null, zero_pad
from earmark.operators.distribution import join_hot, join_one_row, number_all
from earmark.operators.evaluate import phase_of_config

# Places a locator may be given, in order of preference.
LOCATORS = ("url", "path", "file_path")
# Project extensions in order of preference, with the program they belong to.
PROJECT_TYPES = {"als": "ableton", "flp": "flstudio", "logicx": "logic", "logic": "logic"}
# Endings a project name may have beyond the name of its track, in order.
PROJECT_ENDINGS = ("", "_final", "_master", "_mix", "_export")
AUDIO_TYPES = ("wav", "mp3")

MANIFEST_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "url", "path", "file_path", "genre", "daw_file", "daw_metadata_path")]
)


# ---------------------------------------------------------------- S1 - S3


def with_locator(df: DataFrame) -> DataFrame:
    """Add `locator`, the first of the known locator columns that is not blank."""
    present = [blank_to_null(F.col(c)) for c in LOCATORS if c in df.columns]
    return df.withColumn("locator", F.coalesce(*present) if present else F.lit(None).cast("string"))


def manifest_scan(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """Read a manifest with a fixed schema. CSV columns are found by their header."""
    if fmt == "parquet":
        return with_locator(spark.read.parquet(path))
    if fmt != "csv":
        raise ValueError(f"unknown manifest format: {fmt}")
    if schema is None:
        names = spark.read.option("header", True).csv(path).columns
        known = {f.name: f for f in MANIFEST_SCHEMA.fields}
        schema = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    return with_locator(spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path))


def manifest_validate(df: DataFrame, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejects with a `reason`. An empty manifest is an error.

    `listing(path, readable)` names the files that exist; addresses on the web are not looked up.
    """
    if df.isEmpty():
        raise ValueError("the manifest has no rows")
    rows = df if "locator" in df.columns else with_locator(df)
    reason = F.when(F.col("locator").isNull(), "blank locator")
    if listing is not None:
        files = listing.select(F.col("path").alias("locator"), F.col("readable").alias("_readable"))
        rows = rows.join(files, "locator", "left")
        local = ~is_url(F.col("locator"))
        reason = reason.when(local & F.col("_readable").isNull(), "missing file").when(
            local & ~F.col("_readable"), "unreadable"
        )
    marked = rows.withColumn("reason", reason).drop("_readable")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def is_url(col: Column) -> Column:
    return F.coalesce(col.rlike("^https?://"), F.lit(False))


def manifest_enrich(df: DataFrame, order: Sequence[Column], samples: str = "samples", sample_rate: str = "sample_rate") -> DataFrame:
    """Fill in id and title, split the locator into its kind and derive the duration.

    Rows without an id are called `file_n` by their place in `order`, from 0.
    """
    numbered = number_all(df, order, "_n")
    out = numbered.withColumn("id", F.coalesce(blank_to_null(F.col("id")), F.concat(F.lit("file_"), F.col("_n").cast("string"))))
    out = out.withColumns(
        {
            "title": F.coalesce(blank_to_null(F.col("title")), F.col("id")) if "title" in df.columns else F.col("id"),
            "is_url": is_url(F.col("locator")),
        }
    )
    out = out.withColumns(
        {
            "source_url": F.when(F.col("is_url"), F.col("locator")),
            "source_path": F.when(~F.col("is_url"), F.col("locator")),
        }
    )
    if samples in df.columns and sample_rate in df.columns:
        out = out.withColumn("duration", F.when(F.col(sample_rate) > 0, F.col(samples) / F.col(sample_rate)))
    return out.drop("_n")


# ---------------------------------------------------------------- S4


def content_checksum(df: DataFrame, content: str, key: str) -> DataFrame:
    """SHA-256 of the content, and how many rows share it. Copies are counted before they are joined."""
    hashed = df.withColumn("checksum", F.sha2(F.col(content).cast("binary"), 256))
    copies = hashed.groupBy("checksum").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return (
        join_hot(hashed, copies, ["checksum"], F.col(key))
        .withColumn("copies", F.coalesce("copies", F.lit(1)))
        .withColumn("is_duplicate", F.col("copies") > 1)
    )


# ---------------------------------------------------------------- S5, S6


def file_name(path: Column) -> Column:
    """Last part of a path, without slashes at its end."""
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def list_audio(spark: SparkSession, directory: str) -> DataFrame:
    """Paths of the audio files in a folder. File contents are not read."""
    pattern = "*.{" + ",".join(AUDIO_TYPES) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path")


def manifest_from_listing(paths: DataFrame, genre: str = "test") -> DataFrame:
    """Manifest of the audio files among `paths(path)`: id from the file name, title from the id."""
    stem = file_stem(file_name(F.col("path")))
    return paths.where(F.col("path").rlike(r"\.(" + "|".join(AUDIO_TYPES) + ")$")).select(
        stem.alias("id"), F.initcap(F.translate(stem, "_", " ")).alias("title"), F.col("path").alias("url"), F.lit(genre).alias("genre")
    )


def decode_url(col: Column) -> Column:
    """Percent-decode; a plus sign stays a plus sign, and malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def manifest_from_urls(urls: DataFrame, order: Sequence[Column], genre: str = "hip hop") -> DataFrame:
    """Manifest of `urls(url)`: ids and titles from the last part of each address.

    Different addresses that come to one id get a digest of the address behind it.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.regexp_replace(decode_url(file_name(path)), r'[<>:"/\\|?*]', "_")
    stem = file_stem(name)
    clean = F.substring(F.regexp_replace(stem, "[^a-zA-Z0-9_-]", "_"), 1, 50)
    fallback = F.concat(F.lit("track_"), zero_pad(F.col("_n"), 3))
    named = number_all(urls, order, "_n", 1).select(
        F.when((clean == "") | (clean == "_"), fallback).otherwise(clean).alias("id"),
        decode_url(F.replace(F.translate(stem, "_", " "), F.lit("%20"), F.lit(" "))).alias("title"),
        "url",
        F.lit(genre).alias("genre"),
    )
    shared = named.groupBy("id").agg((F.count_distinct("url") > 1).alias("_shared"))
    own = F.when(F.col("_shared"), F.concat_ws("_", "id", F.substring(F.md5("url"), 1, 12))).otherwise(F.col("id"))
    return join_hot(named, shared, ["id"], F.col("url")).select(own.alias("id"), "title", "url", "genre")


# ---------------------------------------------------------------- S7, S8


def manifest_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`existing` and the rows of `new` whose `file_path` it lacks, called `track{n}` from its size on."""
    size = existing.agg(F.count(F.lit(1)).alias("_size"))
    fresh = (
        new.where(F.col("file_path").isNotNull())
        .groupBy("file_path").agg(*[F.min(c).alias(c) for c in new.columns if c not in ("id", "file_path")])
        .join(existing.select("file_path"), "file_path", "left_anti")
    )
    named = (
        join_one_row(number_all(fresh, [F.col("file_path")], "_n", 1), size)
        .withColumn("id", F.concat(F.lit("track"), (F.col("_size") + F.col("_n")).cast("string")))
        .drop("_n", "_size")
    )
    return existing.unionByName(named.select(*[c for c in named.columns if c in existing.columns]), allowMissingColumns=True)


def duration_filter(tracks: DataFrame, low: float, high: float) -> DataFrame:
    """Tracks between both durations, both included."""
    return tracks.where(F.col("duration").between(low, high))


# ---------------------------------------------------------------- S9 - S11


def link_projects(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Add `project_path`, the best project file of each track, NULL when there is none.

    `tracks(id, file_path)`, `files(path)`. Every place a project may be found becomes a row, and
    the place is the join key.
    """
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    parent = F.regexp_extract(folder, "^(.*)/[^/]*$", 1)
    stem = file_stem(file_name(F.col("file_path")))
    places = [(folder, "", e) for e in PROJECT_TYPES] + [(parent, "", e) for e in PROJECT_TYPES]
    places += [(folder, ending, e) for e in PROJECT_TYPES for ending in PROJECT_ENDINGS if ending]
    options = F.array(
        *[
            F.struct(F.lit(i).alias("priority"), F.concat(where, F.lit("/"), stem, F.lit(f"{ending}.{e}")).alias("path"))
            for i, (where, ending, e) in enumerate(places)
        ]
    )
    found = (
        tracks.select("id", F.explode(options).alias("_o"))
        .select("id", "_o.priority", "_o.path")
        .join(files.select("path").distinct(), "path")
        .groupBy("id")
        .agg(F.min(F.struct("priority", "path")).getField("path").alias("project_path"))
    )
    return tracks.join(found, "id", "left")


def project_metadata_resolve(tracks: DataFrame, stored: DataFrame, parsed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Metadata of each track: the stored record if there is one, else the parsed one."""
    def record(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.struct(*fields).alias(name))

    joined = tracks.join(record(stored, "_stored"), "id", "left").join(record(parsed, "_parsed"), "id", "left")
    chosen = F.coalesce("_stored", "_parsed")
    source = F.when(F.col("_stored").isNotNull(), "stored").when(F.col("_parsed").isNotNull(), "parsed")
    return joined.select(*tracks.columns, *[chosen[f].alias(f) for f in fields], source.alias("metadata_source"))


def detect_project_type(path: Column) -> Column:
    """Program a project file belongs to by its extension, NULL when unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)/*$", 1))
    kinds = F.create_map(*[x for k, v in PROJECT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(kinds, extension)


# ---------------------------------------------------------------- S12, S14


def batch_outcome_summary(results: DataFrame) -> DataFrame:
    """Totals of a batch with `status` and `reason`."""
    good = F.col("status") == "ok"
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("successful"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"),
    )


def batch_failures(results: DataFrame) -> DataFrame:
    """Failures of a batch by reason."""
    return results.where(~F.coalesce(F.col("status") == "ok", F.lit(False))).groupBy("reason").agg(F.count(F.lit(1)).alias("failures"))


def run_catalog(runs: DataFrame) -> DataFrame:
    """Runs with their phase, newest first: `runs(run_id, metrics, has_summary, modified)`.

    The phase comes from the summary, then from the test details, then from the configuration name.
    """
    get = lambda path: blank_to_null(F.get_json_object("metrics", path))
    known = lambda col: F.when(col != "unknown", col)
    phase = F.coalesce(
        known(F.coalesce(get("$.summary.phase"), get("$.test_details.phase"), F.lit("unknown"))),
        phase_of_config(F.coalesce(get("$.test_details.config_file"), F.lit(""))),
    )
    return runs.select(
        "run_id",
        F.col("metrics").isNotNull().alias("has_metrics"),
        "has_summary",
        "modified",
        get("$.summary.total_queries").cast("bigint").alias("total_queries"),
        F.when(F.col("metrics").isNotNull(), phase).alias("phase"),
        F.when(F.col("metrics").isNotNull() & F.col("has_summary"), "complete").otherwise("incomplete").alias("state"),
    ).orderBy(F.col("modified").desc(), "run_id")
