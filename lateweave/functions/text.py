"""Text rules as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters stripped by Python's str.strip().
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column) -> Column:
    """Strip all Unicode whitespace on both ends (SQL ``trim`` only strips U+0020)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def safe_get(arr: Column, i: int) -> Column:
    """Array element or NULL; plain indexing raises under ANSI mode."""
    return F.get(arr, F.lit(i))


def join_words(df: DataFrame, name: str) -> Column:
    """A list column joined by single spaces; a string column as it is."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.array_join(F.col(name), " ")
    return F.col(name)


def longer_than(c: Column, n: int) -> Column:
    """Strictly more than ``n`` code points, no stripping."""
    return F.length(c) > n


def non_empty_text(c: Column) -> Column:
    return F.length(c) > 0


def format_query(prompt: Column, query: Column) -> Column:
    """``prompt + newline + "Query: " + query``, or whichever of the two is not empty."""
    p = py_strip(null_to_empty(prompt))
    q = py_strip(null_to_empty(query))
    both = (p != "") & (q != "")
    return F.when(both, F.concat(p, F.lit("\nQuery: "), q)).when(p != "", p).otherwise(q)


def text_column(df: DataFrame, names: tuple[str, ...] = ("content", "text")) -> Column:
    """The first of ``names`` that exists, else "". An existing column is used even if null."""
    for name in names:
        if name in df.columns:
            return F.col(name).cast("string")
    return F.lit("")


def preview(c: Column, n: int = 60) -> Column:
    """The first ``n`` characters, for display only."""
    return F.substring(c, 1, n)


def route_length(split: Column, query_length: int = 256, short_length: int = 32,
                 short_mark: str = "pony") -> Column:
    """Query length per split: splits whose name contains ``short_mark`` get the short one."""
    return (F.when(F.contains(split, F.lit(short_mark)), short_length)
            .otherwise(query_length).cast("int"))
