"""Checks that run on tables, as tables: ``rule, n_violations``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import CATEGORIES
from .papers import ADOPTION_FLAGS, ADOPTION_RATIOS, KINDS


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules in one pass; a null condition is no violation."""
    row = df.agg(*[F.count_if(v).alias(f"r{i}") for i, v in enumerate(rules.values())])
    cells = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").alias("n_violations")) for i, k in enumerate(rules)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def metric_rule_report(metrics: DataFrame) -> DataFrame:
    """Identities, bounds, ratios, nulls and flags of paper adoption metrics."""
    c = F.col
    rules = {"invalid year": c("PYEAR").isNull(), "invalid paper": c("PMID").isNull() | (F.trim("PMID") == "")}
    rules["categories add up"] = sum(c(f"n_{k}") for k in KINDS) != c("n_triples")
    rules["new categories add up"] = sum(c(f"n_{k}") for k in KINDS[:3]) != c("n_new_triples")
    rules["adopted add up"] = sum(c(f"n_{k}_adopted") for k in KINDS[:3]) != c("n_new_triples_adopted")
    rules["reappeared add up"] = c("n_new_triples_adopted") + c("n_repeated_triple_continued") != c("n_triples_reappeared")
    for s, n, d in ADOPTION_RATIOS:
        rules[f"{n} within {d}"] = (c(n) < 0) | (c(n) > c(d))
        rules[f"{s} is the ratio"] = ((c(d) == 0) & c(s).isNotNull()) | ((c(d) > 0) & (c(s).isNull() | F.isnan(s) | (F.abs(c(s) - c(n) / F.nullif(c(d), F.lit(0))) > 1e-9)))
    for k in ADOPTION_FLAGS:
        rules[f"has_{k} is a flag"] = c(f"has_{k}") != (c(f"n_{k}") > 0).cast("int")
    return rule_report(metrics, rules)


def annotation_flag_report(annotated: DataFrame) -> DataFrame:
    """The category against the flags, and the flags against each other."""
    c = lambda n: F.col(f"{n}_in_prior_window")
    fresh = ~c("subject_seen") | ~c("object_seen")
    expected = F.when(fresh, CATEGORIES[0]).when(~c("pair_connected"), CATEGORIES[1]).when(~c("exact_edge_seen"), CATEGORIES[2]).otherwise(CATEGORIES[3])
    return rule_report(annotated, {
        "category follows the flags": F.col("edge_annotation") != expected, "new node flag": F.col("has_new_node") != fresh, "connected pair with a new node": c("pair_connected") & fresh,
        "exact edge without its pair": c("exact_edge_seen") & ~c("pair_connected"), "reversed edge without its pair": c("reversed_edge_seen") & ~c("pair_connected"),
        "same predicate reversed without reversed": c("same_predicate_reversed_edge_seen") & ~c("reversed_edge_seen"), "self loop": F.col("s") == F.col("o"), "pair in order": (F.col("node_a") != F.least("s", "o")) | (F.col("node_b") != F.greatest("s", "o")),
    })


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*keys).agg(*[F.count_distinct(v).alias(f"n_{v}") for v in values]).filter(reduce(lambda a, b: a | b, [F.col(f"n_{v}") > 1 for v in values]))


def conflict_report(df: DataFrame, rules: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    return reduce(DataFrame.union, [conflicts(df, k, v).agg(F.lit(name).alias("rule"), F.count("*").alias("n_violations")).select("rule", "n_violations") for name, (k, v) in rules.items()])


def uniqueness_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Excess rows of each table's key."""
    one = lambda name, df, keys: df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.lit(name).alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_violations")).select("rule", "n_violations")
    return reduce(DataFrame.union, [one(n, df, k) for n, (df, k) in tables.items()])


def set_equality_report(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Distinct rows of one that the other lacks, both ways."""
    one = lambda x, y, side: x.subtract(y).agg(F.lit(f"{name}: {side}").alias("rule"), F.count("*").alias("n_violations")).select("rule", "n_violations")
    return one(a, b, "only left").union(one(b, a, "only right"))


#: Buckets of a table's fingerprint.
BUCKETS = 4096


def fingerprint(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n, a, b``: rows by a hash of ``keys``, how many they are and two sums of hashes of whole rows; no order of rows or columns' partitions matters."""
    hashed = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), F.xxhash64(*df.columns).alias("x"), F.xxhash64(F.lit("again"), *df.columns).alias("y"))
    return hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("a"), F.sum(F.col("y").cast("decimal(20,0)")).alias("b"))


def _same_types(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the names of ``a`` and the types that a union gives them, so that equal values have equal hashes."""
    kinds = a.limit(0).union(b.limit(0)).schema.fields
    cast = lambda df: df.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, kinds, strict=True)])
    return cast(a), cast(b)


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """Both tables' rows in buckets whose fingerprints differ; None if none does, after one scan of each.

    At most BUCKETS numbers reach the driver.
    """
    x, y = fingerprint(a, keys), fingerprint(b, keys).withColumnsRenamed({k: f"{k}2" for k in ("bucket", "n", "a", "b")})
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2"))
    found = [r[0] for r in x.join(y, F.col("bucket") == F.col("bucket2"), "full").filter(~same).select(F.coalesce("bucket", "bucket2")).collect()]
    if not found:
        return None
    of = lambda df: df.filter(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).isin(found))
    return of(a), of(b)


def bag_equality_report(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows of one that the other lacks, repeated rows counted, both ways.

    Fingerprints are compared first; only buckets that differ are compared row by row, so equal tables cost a scan each and no shuffle of rows.
    """
    a, b = _same_types(a, b)
    some = differing(a, b, a.columns)
    if some is None:
        return a.sparkSession.createDataFrame([(f"{name}: {side}", 0) for side in ("only left", "only right")], "rule string, n_violations long")
    a, b = some
    one = lambda x, y, side: x.exceptAll(y).agg(F.lit(f"{name}: {side}").alias("rule"), F.count("*").alias("n_violations")).select("rule", "n_violations")
    return one(a, b, "only left").union(one(b, a, "only right"))


def recompute_report(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Column by column, in how many keys a stored table differs from a fresh one (numbers by more than 1e-9).

    Keys whose bucket has equal fingerprints in both don't meet.
    """
    cols = [c for c in stored.columns if c != key]
    stored, fresh = _same_types(stored.select(key, *cols), fresh.select(key, *cols))
    some = differing(stored, fresh, [key])
    stored, fresh = some or (stored.limit(0), fresh.limit(0))
    met = stored.select(key, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in cols]).join(fresh.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in cols]), key, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    numeric = {f.name for f in stored.schema.fields if f.dataType.typeName() in ("double", "float")}
    differs = lambda c: ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= 1e-9, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull()) if c in numeric else ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return rule_report(met, {"only stored": F.col("__b").isNull(), "only fresh": F.col("__a").isNull()} | {f"{c} differs": both & differs(c) for c in cols})


def combine_report(metrics: DataFrame, years: DataFrame) -> DataFrame:
    """Yearly tables put together: every year there, papers in one year only."""
    missing = years.join(metrics.select("PYEAR").distinct(), "PYEAR", "left_anti").agg(F.lit("year without rows").alias("rule"), F.count("*").alias("n_violations"))
    twice = metrics.groupBy("PMID").agg(F.count("*").alias("n"), F.count_distinct("PYEAR").alias("y")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("a"), F.count_if(F.col("y") > 1).alias("b"))
    cells = F.array(F.struct(F.lit("repeated paper").alias("rule"), F.col("a").alias("n_violations")), F.struct(F.lit("paper in several years").alias("rule"), F.col("b").alias("n_violations")))
    return missing.union(twice.select(F.explode(cells).alias("x")).select("x.*"))


def year_bounds_report(papers: DataFrame, years: DataFrame) -> DataFrame:
    """Year-level distinct counts lie between the largest paper's and the sum of all papers'."""
    names = ("n_unique_concepts", "n_unique_new_concepts", "n_unique_concept_pairs", "n_unique_new_combination_pairs", "n_triples")
    per = papers.groupBy("PYEAR").agg(*[x for n in names for x in (F.max(n).alias(f"max_{n}"), F.sum(n).alias(f"sum_{n}"))])
    met = years.select("PYEAR", *names).join(per, "PYEAR")
    return rule_report(met, {f"{n} out of bounds": (F.col(n) < F.col(f"max_{n}")) | (F.col(n) > F.col(f"sum_{n}")) for n in names})
