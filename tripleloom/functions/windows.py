"""Moving windows of years over keys, each row read once for all years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def prior(keys: Sequence[str], year: str, w: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(year).rangeBetween(-w, -1)


def following(keys: Sequence[str], year: str, w: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(year).rangeBetween(1, w)


def seen_before(df: DataFrame, keys: Sequence[str], year: str, w: int, flag: str = "seen") -> DataFrame:
    """Distinct (keys, year) and whether the key occurs in the ``w`` years before."""
    return df.select(*keys, year).distinct().withColumn(flag, F.max(year).over(prior(keys, year, w)).isNotNull())


def seen_after(df: DataFrame, keys: Sequence[str], year: str, w: int, flag: str = "seen") -> DataFrame:
    """Distinct (keys, year) and whether the key occurs in the ``w`` years after."""
    return df.select(*keys, year).distinct().withColumn(flag, F.min(year).over(following(keys, year, w)).isNotNull())


def union_sizes(df: DataFrame, keys: Sequence[str], year: str, w: int, out: str) -> DataFrame:
    """For each year, how many distinct keys occur in the ``w`` years before it.

    An occurrence counts for the years after it up to ``w`` or to the key's
    next occurrence, whichever comes first, so each key counts once.
    """
    events = df.select(*keys, F.col(year).alias("__y")).distinct()
    events = events.withColumn("__next", F.min("__y").over(following(keys, "__y", w)))
    years = F.sequence(F.col("__y") + 1, F.least(F.col("__y") + w, F.coalesce("__next", F.col("__y") + w)))
    return events.select(F.explode(years).alias(year)).groupBy(year).agg(F.count("*").alias(out))


def year_bounds(df: DataFrame, year: str) -> tuple[int | None, int | None]:
    row = df.agg(F.min(year).alias("a"), F.max(year).alias("b")).first()
    return row["a"], row["b"]
