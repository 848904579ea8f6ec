"""Diagnostics: context around markers and matches, carried values, one notice by its reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions import extract

BEFORE, AFTER = 10, 10
RUNS_BEFORE, RUNS_AFTER = 8, 11
# Exact dates and numbers of a notice.
DATES = r"\b20\d{2}[./-]\d{1,2}[./-]\d{1,2}\b|\b\d{1,2}[./-]\d{1,2}[./-]20\d{2}\b"
NUMBERS = r"\b\d[\d.,/ -]{1,18}\d\b|\b\d{2,}\b"


def marker_context(items: DataFrame, keys: list[str], order: str, marker: str, value: str, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """keys, order, marker, context: for each marker, the values from `before` rows before to `after` after."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    near = items.withColumn("context", F.collect_list(F.coalesce(F.col(value), F.lit(""))).over(frame))
    return near.where(F.col(marker).isNotNull()).select(*keys, order, marker, "context")


def carried(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add `out`: the last value that is not null at or before each row (a font set before the text)."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(so_far))


def around_first(rows: DataFrame, keys: list[str], order: str, hit: Column, before: int = RUNS_BEFORE, after: int = RUNS_AFTER) -> DataFrame:
    """The rows from `before` before the first hit of each group to `after` after it; none without a hit."""
    w = Window.partitionBy(*keys).orderBy(order)
    placed = rows.withColumn("_n", F.row_number().over(w)).withColumn("_at", F.min(F.when(hit, F.col("_n"))).over(Window.partitionBy(*keys)))
    return placed.where(F.col("_n").between(F.col("_at") - before, F.col("_at") + after)).drop("_n", "_at")


def notice(segments: DataFrame, reference: str) -> DataFrame:
    """The first segment of each issue with this reference."""
    own = segments.where(F.col("reference") == reference)
    first = Window.partitionBy("issue").orderBy("segment")
    return own.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def exact_tokens(body: Column) -> Column:
    """struct(dates, numbers): the distinct exact dates and numbers of a text, in order, trimmed."""
    of = lambda p: F.array_distinct(F.transform(extract.tokens(body, p), lambda t: F.trim(t)))
    return F.struct(of(DATES).alias("dates"), of(NUMBERS).alias("numbers"))
