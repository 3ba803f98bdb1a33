"""One row for each paper with everything known about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import pmid_strict, work_strict

MODULES = ("annotation", "pattern", "new_knowledge", "adoption", "development", "decomposition")


def owners(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Which table each metric is taken from: the first that has it."""
    out: dict[str, str] = {}
    for name, df in tables.items():
        for c in df.columns:
            if c not in ("PMID", "PYEAR"):
                out.setdefault(c, name)
    return out


def shared_metric_conflicts(tables: dict[str, DataFrame]) -> DataFrame:
    """Metrics that two tables have, and in how many papers they differ (by more than 1e-9); one join for each pair of tables."""
    first, pairs = owners(tables), {}
    for name, df in tables.items():
        for c in df.columns:
            if c in first and first[c] != name:
                pairs.setdefault((first[c], name), []).append(c)
    found = []
    for (a, b), cols in pairs.items():
        met = tables[a].select("PMID", *[F.col(c).alias(f"a_{c}") for c in cols]).join(tables[b].select("PMID", *[F.col(c).alias(f"b_{c}") for c in cols]), "PMID")
        differ = lambda c: ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= 1e-9, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
        counts = met.agg(*[F.count_if(differ(c)).alias(c) for c in cols])
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n_conflicts")) for c in cols])
        found.append(counts.select(F.lit(a).alias("retained_source"), F.lit(b).alias("checked_source"), F.explode(cells).alias("x")).select("retained_source", "checked_source", "x.*"))
    return reduce(DataFrame.union, found)


def one_to_one(tables: dict[str, DataFrame], papers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers of the annotation with exactly one work that is theirs alone, and the others with the reason."""
    a = tables["annotation"].select(pmid_strict(F.col("PMID")).alias("pmid"), F.col("PYEAR").alias("pyear")).join(papers.select("pmid", "n_works", "has_work_shared_with_other_pmids"), "pmid", "left").withColumn("n_works", F.coalesce("n_works", F.lit(0)))
    good = (F.col("n_works") == 1) & ~F.coalesce("has_work_shared_with_other_pmids", F.lit(False))
    kept = a.filter(good).select("pmid", "pyear").join(links.select("pmid", F.col("work_id").alias("workid"), "openalex_year"), "pmid")
    reason = F.when(F.col("n_works") == 0, "no_openalex_mapping").when(F.col("n_works") != 1, "multiple_workids").otherwise("workid_shared_with_other_pmids")
    return kept, a.filter(~good).select("pmid", "pyear", "n_works", reason.alias("reason"))


def source_fields(papers2: DataFrame) -> DataFrame:
    """The second source's fields as ``sci_*``, its year as ``sciscinet_year``."""
    return papers2.select(work_strict(F.col("paperid")).alias("workid"), F.col("year").try_cast("int").alias("sciscinet_year"), *[F.col(c).alias(f"sci_{c}") for c in papers2.columns if c not in ("paperid", "year", "PMID")])


def paper_master(tables: dict[str, DataFrame], papers: DataFrame, links: DataFrame, papers2: DataFrame, adoption_end: int, citation_end: int | None = None) -> DataFrame:
    """The master table; joins on PMID only, shared metrics kept once."""
    kept, _ = one_to_one(tables, papers, links)
    out = kept.join(source_fields(papers2), "workid")
    first = owners(tables)
    for name, df in tables.items():
        own = [c for c in df.columns if first.get(c) == name]
        out = out.join(df.select(F.col("PMID").alias("pmid"), *own, F.lit(True).alias(f"has_{name}_metrics")), "pmid", "left").withColumn(f"has_{name}_metrics", F.coalesce(f"has_{name}_metrics", F.lit(False)))
    p, o, s = F.col("pyear"), F.col("openalex_year"), F.col("sciscinet_year")
    return out.withColumns({
        "year_match_semmed_openalex": p == o, "year_match_semmed_sciscinet": p == s, "year_match_openalex_sciscinet": o == s, "year_diff_openalex_semmed": o - p, "year_diff_sciscinet_semmed": s - p,
        "eligible_adoption": p <= adoption_end, **{f"eligible_c{k}": F.lit(None).cast("boolean") if citation_end is None else s + k <= citation_end for k in (3, 5, 10)},
    })


def master_exclusions(tables: dict[str, DataFrame], papers: DataFrame, links: DataFrame, papers2: DataFrame) -> DataFrame:
    """Papers of the annotation that the master lacks, with the reason."""
    kept, out = one_to_one(tables, papers, links)
    lost = kept.join(source_fields(papers2).select("workid"), "workid", "left_anti")
    return out.union(lost.select("pmid", "pyear", F.lit(1).cast("bigint"), F.lit("missing_in_second_source")))


def sample_flow(tables: dict[str, DataFrame], papers: DataFrame, links: DataFrame, papers2: DataFrame) -> DataFrame:
    """One row: papers of the annotation, those with one work of their own, and what the second source has of them.

    Of ``tables`` only the papers of ``annotation`` are read.
    """
    kept, out = one_to_one(tables, papers, links)
    source = source_fields(papers2).select("workid").distinct().withColumn("found", F.lit(True))
    met = kept.select("workid").join(source, "workid", "left").agg(F.count("*").alias("n_one_to_one_pmids"), F.count_if(F.col("found").isNull()).alias("n_excluded_missing_source"), F.count_if("found").alias("n_output_pmids"))
    lost = out.agg(F.count("*").alias("n_excluded_mapping"))
    every = tables["annotation"].agg(F.count("*").alias("n_annotation_pmids"))
    return every.crossJoin(met).crossJoin(lost).select("n_annotation_pmids", "n_one_to_one_pmids", "n_excluded_mapping", "n_excluded_missing_source", "n_output_pmids")  # one row each


def master_by_year(master: DataFrame) -> DataFrame:
    flags = {"n_openalex_year_equal": "year_match_semmed_openalex", "n_sciscinet_year_equal": "year_match_semmed_sciscinet", "n_adoption_rows": "has_adoption_metrics", "n_development_rows": "has_development_metrics"}
    return master.groupBy("pyear").agg(F.count("*").alias("n_pmids"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.count(f"sci_C{k}").alias(f"n_nonmissing_c{k}") for k in (3, 5, 10)])


def missingness(df: DataFrame) -> DataFrame:
    """``variable, n_rows, n_missing`` of every column, in one scan."""
    row = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing")) for c in df.columns])
    return row.select(F.col("__rows").alias("n_rows"), F.explode(cells).alias("x")).select("x.variable", "n_rows", "x.n_missing")
