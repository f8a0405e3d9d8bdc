import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(130))
# Nulls, empty and long texts, repeated rows, ties, a null id, and words of more than one byte.
ROWS = [
    (5, LONG, "en", "a"), (3, f"x y {LONG} z", "en", "a"), (3, f"x y {LONG} z", "en", "a"), (9, LONG[:400], "fr", None),
    (None, LONG, None, "b"), (1, None, "en", "b"), (2, "", None, None), (7, "q " * 3000, "en", "b"),
    (8, "é " + "q " * 120, "en", "zé"), (4, LONG.replace("w60", "ww"), "en", "a"), (11, "a b", "en", "a"), (10, "A  b", "en", "a"),
    (12, "mail a.b@c.org or +1 (269) 555-3296 4524132264652876, host 10.1.2.3.", "en", "a"), (13, "same\nsame\n\nsame\n# $", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """A small table of awkward rows, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in ("size", "shard", "fp", "h", "n", "part", "u", "v", "slice", "rate", "low", "root", "doc", "kept"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
