"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, its target share of the rows over its
present share.  A document's count inverts the Poisson distribution of that
mean at a uniform number hashed from seed and id; each copy is a row, and the
rows are dealt and ordered by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and parts, of 52 bits."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _log_term(k: Column, rate: Column) -> Column:
    """The logarithm of the probability of ``k``; by Stirling's series beyond 20, where its parts nearly cancel."""
    few = k * F.log(rate) - rate - F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))
    rest = 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5) - 1 / (1680 * k**7)
    return F.when(k > 20, k - rate - k * F.log(k / rate) - rest).otherwise(few)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``source, first, cdf``: the distribution function at ``first``, the next
    count and so on, a row for each source with a mean above 0.

    The counts left out, 12 standard deviations and 40 from the mean, have less
    than 2**-52.
    """
    rate, k, reach = F.col("rate"), F.col("k"), 12 * F.sqrt("rate") + 40
    bounds = rates.filter("rate > 0").select("source", "rate", F.greatest(F.floor(rate - reach), F.lit(0)).cast("long").alias("first"), F.ceil(rate + reach).cast("long").alias("last"))
    counts = bounds.select("source", "rate", "first", F.explode(F.sequence("first", "last")).alias("k")).withColumn("k", k.cast("double"))
    terms = counts.withColumn("term", F.exp(_log_term(k, rate)))
    summed = terms.select("source", "first", F.struct("k", F.sum("term").over(Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("c")).alias("at"))
    return summed.groupBy("source").agg(F.first("first").alias("first"), F.transform(F.sort_array(F.collect_list("at")), lambda x: x["c"]).alias("cdf"))


def replication_rates(docs: DataFrame, targets: dict[str, float] | None = None, source_col: str = "source", max_rate: float | None = 4.0, other: float = 0.0) -> DataFrame:
    """``source, n, rate``: a row for each source, the null source as ``''``.

    Without ``targets`` every source gets the same share; with them, shares are
    the weights of the sources that there are over their sum, and a source that
    they don't name has the weight ``other``.
    ``max_rate`` caps a mean rate, None doesn't.  Nothing makes up for a cut: a
    source below 1 / ``max_rate`` of its target misses it, and the shares of
    the others rise.
    """
    counts = stash(docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n")))
    weight = F.lit(1.0)
    if targets is not None:
        known = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]) if targets else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(float(other)))
    total = counts.agg(F.sum("n").alias("n"), F.sum(weight).alias("w")).first()
    rate = weight * (float(total["n"] or 0) / (total["w"] or 1.0)) / F.col("n")
    return counts.select("source", "n", (rate if max_rate is None else F.least(F.lit(float(max_rate)), rate)).alias("rate"))


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", max_rate: float | None = None, other: float = 0.0) -> DataFrame:
    """All columns of ``docs`` with ``copy`` (1, 2, ...) and ``shuffle_key``,
    dealt by the key and ordered by it within each partition.

    Every source reaches its target on average; ``max_rate`` caps the
    repetition at the price of the weights, see :func:`replication_rates`.
    A null id counts as the empty text, a null source as ``''``; rows that
    repeat an id get the same count and equal keys, and lie in any order among
    themselves.  Texts are never looked at, so their length doesn't matter.  No
    rows give no rows.  Should ``docs`` have columns of these two names, they
    are replaced.
    """
    rates = stash(poisson_tables(replication_rates(docs, targets, source_col, max_rate, other)).select(F.col("source").alias("__source"), F.col("first").alias("__first"), F.col("cdf").alias("__cdf")))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    plain = docs.drop("copy", "shuffle_key").withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    counted = plain.join(rates, "__source").withColumn("__u", uniform(seed, ident))
    count = (F.col("__first") + F.size(F.filter("__cdf", lambda c: F.col("__u") >= c))).cast("int")
    copies = counted.withColumn("__n", count).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws("|", F.lit(seed + "/order"), ident, F.col("copy").cast("string"))), 1, 16))
    return keyed.drop("__source", "__first", "__cdf", "__u", "__n").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
