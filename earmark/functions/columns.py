"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_MARK = "_seg_"

# Characters that may not appear in a file name.
UNSAFE_NAME_CHARS = '/\\:*?"<>|'

# Longest rendered variant id and length of the digest that replaces its tail.
VARIANT_ID_LIMIT = 200
VARIANT_ID_DIGEST = 8


def blank_to_null(col: Column) -> Column:
    """NULL for empty or all-space text, the trimmed text otherwise."""
    trimmed = F.trim(col)
    return F.when(trimmed != "", trimmed)


def safe_name(col: Column) -> Column:
    """Replace every character that file systems refuse by an underscore."""
    return F.translate(col, UNSAFE_NAME_CHARS, "_" * len(UNSAFE_NAME_CHARS))


def zero_pad(col: Column, width: int) -> Column:
    """Left-pad a number with zeros; longer numbers keep all their digits."""
    text = col.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def segment_id(track: Column, segment_idx: Column) -> Column:
    """Render `(track, index)` as `track_seg_0007`."""
    return F.concat(track, F.lit(SEGMENT_MARK), zero_pad(segment_idx, 4))


def track_of_segment(col: Column) -> Column:
    """Track part of a segment id; an id without a segment mark is a track already."""
    return F.substring_index(col, SEGMENT_MARK, 1)


def index_of_segment(col: Column) -> Column:
    """Segment number of a segment id, NULL when the id names a whole track."""
    return F.when(col.rlike("_seg_[0-9]+$"), F.regexp_extract(col, "_seg_([0-9]+)$", 1).cast("bigint"))


def variant_id(track: Column, transform_type: Column, params: Column) -> Column:
    """Deterministic id of one variant from a `map<string,string>` of parameters sorted by name."""
    pairs = F.array_sort(F.map_entries(params))
    rendered = F.array_join(
        F.transform(
            pairs,
            lambda p: F.concat(p["key"], F.lit("_"), safe_name(F.coalesce(p["value"], F.lit("None")))),
        ),
        "_",
    )
    full = F.concat(track, F.lit("__"), transform_type, F.lit("__"), rendered)
    head = F.substring(full, 1, VARIANT_ID_LIMIT - VARIANT_ID_DIGEST - 1)
    short = F.concat(head, F.lit("_"), F.substring(F.md5(full.cast("binary")), 1, VARIANT_ID_DIGEST))
    return F.when(F.length(full) > VARIANT_ID_LIMIT, short).otherwise(full)


def finite_or_null(col: Column) -> Column:
    """NULL for NaN and both infinities."""
    value = col.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(col)


def _finite(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite_or_null(col)
    if isinstance(dtype, T.ArrayType) and _has_floats(dtype):
        return F.transform(col, lambda x: _finite(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and _has_floats(dtype):
        fields = [_finite(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and _has_floats(dtype.valueType):
        return F.transform_values(col, lambda _, v: _finite(v, dtype.valueType))
    return col


def _has_floats(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_floats(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_floats(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_floats(f.dataType) for f in dtype.fields)
    return False


def sanitize_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column, also inside arrays, maps and structs."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def value_bin(col: Column, per_octave: int = 256) -> Column:
    """A coarse bin that never decreases when the value grows.

    Used to cut a huge group into pieces that sort independently. Bins are logarithmic with
    `per_octave` steps for each doubling, so they depend on the value alone and no range scan of
    the group is needed. Magnitudes outside 2^-30 .. 2^60 share the outermost bins.
    """
    size = F.least(F.greatest(F.log2(F.abs(col)) + F.lit(30.0), F.lit(0.0)), F.lit(90.0))
    step = F.when(col == 0, F.lit(0)).otherwise(F.floor(size * per_octave).cast("int") + 1)
    return F.when(col < 0, -step).otherwise(step)
