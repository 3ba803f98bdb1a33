"""Exact quantiles of groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Distinct values that one task orders.
RANGE_VALUES = 1_000_000


def exact_quantiles(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """``keys, {column}_q`` with the quantiles of each column at ``shares``, between neighbouring values in proportion; null where a group has no value.

    Values are counted first.  Ranges of (group, value), as many as the distinct values ask for, get running
    counts inside, moved on by the counts of earlier ranges (a row for each range and group), and
    each quantile is read off the two values that hold its ranks.  So no task holds the values of a group,
    however large.  Null keys are a group.  Nulls and NaNs aren't values.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("__of"), F.col(c).cast("double").alias("__v")) for c in columns]))
    long = rows.select(F.struct(*keys).alias("__k"), cells.alias("__c")).select("__k", "__c.*").filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counted = written(long.groupBy("__k", "__of", "__v").agg(F.count("*").alias("__n")))
    ranges = max(1, math.ceil(counted.count() / range_values))
    ranged = written(counted.repartitionByRange(ranges, "__of", "__k", "__v").withColumn("__r", F.spark_partition_id()), counted)
    group = ["__of", "__k"]
    sizes = ranged.groupBy("__r", *group).agg(F.sum("__n").alias("__s"))
    of_group = Window.partitionBy(*group)
    before = sizes.select("__r", *group, (F.sum("__s").over(of_group.orderBy("__r")) - F.col("__s")).alias("__before"), F.sum("__s").over(of_group).alias("__total"))
    upto = F.sum("__n").over(Window.partitionBy("__r", *group).orderBy("__v"))
    placed = ranged.withColumn("__upto", upto).join(before, ["__r", *group])  # no group is null: each is a struct
    end = F.col("__before") + F.col("__upto")
    holds = lambda rank: (end - F.col("__n") <= rank) & (rank < end)
    place = lambda q: (F.col("__total") - 1) * F.lit(float(q))
    picks = [x for i, q in enumerate(shares) for x in (F.max(F.when(holds(F.floor(place(q))), F.col("__v"))).alias(f"lo{i}"), F.max(F.when(holds(F.ceil(place(q))), F.col("__v"))).alias(f"hi{i}"))]
    found = placed.groupBy(*group).agg(F.first("__total").alias("__total"), *picks)

    def between(i: int, q: float) -> Column:
        lo, hi, at = F.col(f"lo{i}"), F.col(f"hi{i}"), place(q)
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    values = found.select(*group, F.array(*[between(i, q) for i, q in enumerate(shares)]).alias("__q"))
    wide = values.groupBy("__k").agg(*[F.max(F.when(F.col("__of") == c, F.col("__q"))).alias(f"{c}_q") for c in columns])
    return wide.select("__k.*", *[f"{c}_q" for c in columns])


def with_quantiles(summary: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``summary``, a row for each group of ``keys``, with the quantiles of :func:`exact_quantiles`."""
    found = exact_quantiles(rows, keys, columns, shares).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return summary.join(found, on, "left").drop(*[f"__{k}" for k in keys])
