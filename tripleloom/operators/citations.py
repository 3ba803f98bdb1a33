"""Citation windows, and agreement with a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import pmid_strict, share, work_strict

WINDOWS = (3, 5, 10)


def citation_windows(references: DataFrame, years: DataFrame, cutoff: int) -> DataFrame:
    """For each work with a year: references made and citations received 3, 5, 10 years on and up to ``cutoff``.

    ``references(work_id, referenced_work_id)`` may repeat a pair, each counts;
    ``years(work_id, year)`` has one row for each work.
    """
    made = references.join(years.select("work_id", F.col("year").alias("citing_year")), "work_id").filter(F.col("citing_year") <= cutoff)
    n_made = made.groupBy("work_id").agg(F.count("*").alias("n_references"))
    got = made.select(F.col("referenced_work_id"), "citing_year").groupBy("referenced_work_id", "citing_year").agg(F.count("*").alias("n")).withColumnRenamed("referenced_work_id", "work_id")
    gap = F.col("citing_year") - F.col("year")
    received = got.join(years, "work_id").filter(gap >= 0).groupBy("work_id").agg(*[F.sum(F.when(gap <= k, F.col("n")).otherwise(0)).alias(f"citation_C{k}") for k in WINDOWS], F.sum("n").alias("citation_through_cutoff"))
    out = years.join(n_made, "work_id", "left").join(received, "work_id", "left")
    counts = ("n_references", *(f"citation_C{k}" for k in WINDOWS), "citation_through_cutoff")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumns({f"has_complete_C{k}_window": F.col("year") + k <= cutoff for k in WINDOWS}).withColumnRenamed("year", "publication_year")


def with_pmids(windows: DataFrame, ids: DataFrame) -> DataFrame:
    """The windows with each work's least PMID, null if it has none; ``ids(work_id, pmid)`` as they are written."""
    known = ids.select(work_strict(F.col("work_id")).alias("work_id"), pmid_strict(F.col("pmid")).alias("pmid")).filter("work_id is not null and pmid is not null")
    return windows.join(known.groupBy("work_id").agg(F.min("pmid").alias("pmid")), "work_id", "left")


def citation_edge_accounting(references: DataFrame, years: DataFrame, cutoff: int) -> DataFrame:
    """One row: what became of each reference."""
    both = references.join(years.select("work_id", F.col("year").alias("citing")), "work_id", "left").join(years.select(F.col("work_id").alias("referenced_work_id"), F.col("year").alias("cited")), "referenced_work_id", "left")
    known = F.col("citing").isNotNull() & F.col("cited").isNotNull()
    gap = F.col("citing") - F.col("cited")
    return both.agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("citing").isNull()).alias("n_citing_year_unknown"), F.count_if(F.col("cited").isNull()).alias("n_cited_year_unknown"), F.count_if(known & (gap < 0)).alias("n_negative_gap"),
        F.count_if(known & (gap >= 0) & (F.col("citing") <= cutoff)).alias("n_used"), *[F.count_if(known & gap.between(0, k) & (F.col("citing") <= cutoff)).alias(f"n_used_C{k}") for k in WINDOWS],
    )


def _once(df: DataFrame, name: str) -> DataFrame:
    """Rows with an id, each of which must be the only one of its id."""
    rest = [c for c in df.columns if c != "work_id"]
    rows = df.filter("work_id is not null").groupBy("work_id").agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__x"))
    gate = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"several rows in {name} of work "), F.col("work_id")))).otherwise(F.col("__x"))
    return rows.select("work_id", gate.alias("__x")).select("work_id", "__x.*")


def citation_match(ours: DataFrame, other: DataFrame) -> DataFrame:
    """Works of both sources in the same year with their counts and differences.

    ``other(work_id, other_year, other_C3, other_C5, other_C10)``; a work that
    repeats in either source is an error when the result is read, one without an id doesn't match.
    """
    met = _once(ours, "ours").join(_once(other, "the other source"), "work_id").filter(F.col("publication_year") == F.col("other_year"))
    out = met.select("work_id", "publication_year", *[F.col(f"citation_C{k}") for k in WINDOWS], *[F.col(f"other_C{k}").cast("bigint").alias(f"other_C{k}") for k in WINDOWS])
    return out.withColumns({f"difference_C{k}": F.col(f"citation_C{k}") - F.col(f"other_C{k}") for k in WINDOWS})


def match_coverage(ours: DataFrame, other: DataFrame) -> DataFrame:
    """One row: works of each source, in both, in the same year."""
    a, b = ours.select("work_id", "publication_year").distinct(), other.select("work_id", "other_year").distinct()
    met = a.join(b, "work_id", "full")
    both = F.col("publication_year").isNotNull() & F.col("other_year").isNotNull()
    return met.agg(F.count("publication_year").alias("n_ours"), F.count("other_year").alias("n_other"), F.count_if(both).alias("n_both"), F.count_if(both & (F.col("publication_year") == F.col("other_year"))).alias("n_same_year"))


def _long(matched: DataFrame) -> DataFrame:
    """``window, x, y``, a row for each work and window where both counts are known."""
    rows = F.array(*[F.struct(F.lit(f"C{k}").alias("window"), F.col(f"citation_C{k}").cast("double").alias("x"), F.col(f"other_C{k}").cast("double").alias("y")) for k in WINDOWS])
    return matched.select("publication_year", F.explode(rows).alias("r")).select("publication_year", "r.*").filter("x is not null and y is not null")


def _pearson(x: str, y: str) -> Column:
    """Null for fewer than two rows or a constant side."""
    vary = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    n, d = F.count("*"), F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / F.count("*")
    sx, sy = (F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / n for c in (x, y))
    return F.when(vary, F.try_divide(d, F.sqrt(F.when(sx > 0, sx)) * F.sqrt(F.when(sy > 0, sy))))


def _agreement(rows: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("x") - F.col("y")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(_pearson("x", "y"), 9).alias("pearson"), F.round(F.sqrt(F.avg(d * d)), 9).alias("rmse"), F.round(F.avg(F.abs(d)), 9).alias("mae"), F.round(F.avg(d), 9).alias("mean_difference"),
        share(F.count_if(d == 0), F.count("*")).alias("share_equal"), share(F.count_if((F.col("x") == 0) == (F.col("y") == 0)), F.count("*")).alias("share_zero_agreement"),
    )


def agreement_summary(matched: DataFrame) -> DataFrame:
    return _agreement(_long(matched), ["window"])


def agreement_by_year(matched: DataFrame) -> DataFrame:
    return _agreement(_long(matched), ["window", "publication_year"])


def spearman(matched: DataFrame) -> DataFrame:
    """Rank correlation with average ranks for ties, for each window.

    Values are counted first; ranks come from a running sum over the distinct
    values and are joined back, so no task orders all rows.
    """
    rows = _long(matched)

    def ranks(c: str) -> DataFrame:
        per = rows.groupBy("window", c).agg(F.count("*").alias("n"))
        below = F.sum("n").over(Window.partitionBy("window").orderBy(c)) - F.col("n")
        return per.select("window", c, (below + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    ranked = rows.groupBy("window", "x", "y").agg(F.count("*").alias("w")).join(ranks("x"), ["window", "x"]).join(ranks("y"), ["window", "y"])
    w, a, b = F.col("w"), F.col("rank_x"), F.col("rank_y")
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    va, vb, cov = F.sum(w * a * a) - sa * sa / n, F.sum(w * b * b) - sb * sb / n, F.sum(w * a * b) - sa * sb / n
    return ranked.groupBy("window").agg(n.alias("n"), F.round(F.when((va > 0) & (vb > 0), cov / F.sqrt(F.when(va > 0, va)) / F.sqrt(F.when(vb > 0, vb))), 9).alias("spearman"))


def largest_differences(matched: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` works by absolute difference of the five-year counts, a report."""
    return matched.filter("difference_C5 is not null").orderBy(F.abs("difference_C5").desc(), "work_id").limit(top)
