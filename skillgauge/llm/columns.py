"""Native column expressions shared by the operators: words, lines, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def count_characters(text: Column, of: str) -> Column:
    """How many code points of `text` are in the character class `of`."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{of}]+", ""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def covered(starts: Column, width: Column | int) -> Column:
    """How many positions the windows of one width cover; `starts` is sorted and a plain column."""
    step = F.transform(starts, lambda start, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - start, F.lit(width))))
    return F.aggregate(step, F.lit(0).cast("long"), lambda total, n: total + n)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with `columns` behind a barrier, so that a filter on them is not pushed into the expressions they are made of.

    The optimiser would write those expressions into the filter, and what is a column inside a lambda
    would be worked out anew for every element.
    """
    held = "__held"
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return df.select(*others, F.explode(F.array(row)).alias(held)).select(*others, *[F.col(held)[c].alias(c) for c in columns])
