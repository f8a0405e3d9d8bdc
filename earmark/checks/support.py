"""Helpers of the registered queries: tidy results, and SQL built from named parts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, whole numbers to 64 bits, nested values to JSON text."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), DIGITS)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            col = F.to_json(col)
        out.append(col.alias(f.name))
    return df.select(*out)


def r6(expression: str) -> str:
    """SQL twin of `tidy` for one double; adding zero turns a negative zero into zero."""
    return f"(round({expression}, {DIGITS}) + 0.0)"


class Parts:
    """Named SQL parts; `sql` prepends the parts that a statement uses, in order."""

    def __init__(self) -> None:
        self.parts: dict[str, str] = {}

    def add(self, name: str, body: str) -> None:
        self.parts[name] = body

    def sql(self, body: str) -> str:
        needed: set[str] = set()

        def visit(text: str) -> None:
            for name in set(re.findall(r"[a-z_][a-z0-9_]*", text)) & self.parts.keys():
                if name not in needed:
                    needed.add(name)
                    visit(self.parts[name])

        visit(body)
        used = [f"{n} AS MATERIALIZED ({b})" for n, b in self.parts.items() if n in needed]
        return f"WITH {', '.join(used)} {body}" if used else body
