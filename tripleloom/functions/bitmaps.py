"""Distinct counts that can be merged: sets of dense numbers as bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import numbered


def yearly_bitmaps(rows: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """``y, bucket, bits``: for each year the set of distinct ``keys``, in bitmaps of 32 768 numbers each.

    Keys get dense numbers in their order, so bitmaps are full where keys
    are close and a set of n keys takes n / 8 bytes a year at most.  Rows with a null key or year are left out.
    """
    seen = rows.select(*keys, F.col(year).cast("int").alias("y")).dropna().distinct()
    seen = written(seen)
    ids = numbered(seen.select(*keys).distinct(), keys)
    placed = seen.join(ids, list(keys)).select("y", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit"))
    return placed.groupBy("y", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def sizes(bitmaps: DataFrame, by: str = "y") -> DataFrame:
    """``by, n``: how many keys each set has."""
    return bitmaps.groupBy(by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def unions(bitmaps: DataFrame, spans: DataFrame) -> DataFrame:
    """Sets of several years: ``spans(name, y)`` says which years are in which; each union is an OR of yearly bitmaps."""
    return spans.join(bitmaps, "y").groupBy("name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def prior_sets(bitmaps: DataFrame, windows: Sequence[int]) -> DataFrame:
    """For each year with rows and each window of years before it: sizes of the year, of the union before and of the overlap.

    The overlap is what the two have more than their union, so three counts of bits answer it.
    """
    years = written(sizes(bitmaps)).withColumnRenamed("n", "size")
    cells = [F.struct(F.lit(w).alias("w"), F.lit(own).alias("own")) for w in windows for own in (True, False)]
    wanted = years.select("y", F.explode(F.array(*cells)).alias("c")).select("y", "c.*")
    first = F.when(F.col("own"), 0).otherwise(1)
    spans = wanted.select(F.struct("y", "w", "own").alias("name"), F.explode(F.sequence(F.col("y") - F.col("w"), F.col("y") - first)).alias("y"))
    found = sizes(unions(bitmaps, spans), "name").select("name.*", "n")
    per = found.groupBy("y", "w").agg(F.max(F.when(F.col("own"), F.col("n"))).alias("all"), F.max(F.when(~F.col("own"), F.col("n"))).alias("before"))
    out = years.join(per, "y")
    before = F.coalesce("before", F.lit(0))
    return out.select("y", "w", "size", before.alias("before"), (F.col("size") + before - F.col("all")).alias("overlap"))
