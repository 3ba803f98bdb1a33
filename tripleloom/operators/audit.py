"""Audits of identifiers and years across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import date_year, doi_norm, is_missing, listed, pmid_strict, share, work_strict, year_strict


def agreed(value: Column) -> Column:
    """The value, if all rows of the group have the same valid one; else null."""
    return F.when((F.min(value) == F.max(value)) & (F.count_if(value.isNull()) == 0), F.min(value))


def mappings(ids: DataFrame) -> DataFrame:
    """Valid distinct ``pmid, work_id``."""
    return ids.filter(~is_missing(F.col("pmid"))).select(pmid_strict(F.col("pmid")).alias("pmid"), work_strict(F.col("work_id")).alias("work_id")).filter("pmid is not null and work_id is not null").distinct()


def agreed_year(citations: DataFrame) -> DataFrame:
    """For each paper: how many rows and years, and the year all rows agree on."""
    rows = citations.select(pmid_strict(F.col("PMID")).alias("pmid"), "ISSN", year_strict(F.col("PYEAR")).alias("y"), date_year(F.col("DP")).alias("dp"), date_year(F.col("EDAT")).alias("ed")).filter("pmid is not null")
    return rows.groupBy("pmid").agg(F.count("*").alias("semmed_rows"), listed("ISSN", "; ").alias("journal_issns"), F.count_distinct("y").alias("n_semmed_years"), F.count_if(F.col("y").isNull()).alias("invalid_semmed_year_rows"), agreed(F.col("y")).alias("semmed_year"), agreed(F.col("dp")).alias("dp_year"), agreed(F.col("ed")).alias("edat_year"))


def _work_years(years: DataFrame, prefix: str, work: str, year: str) -> DataFrame:
    rows = years.select(work_strict(F.col(work)).alias("work_id"), year_strict(F.col(year)).alias("y")).filter("work_id is not null")
    return rows.groupBy("work_id").agg(F.count("*").alias(f"{prefix}_rows"), F.count_distinct("y").alias(f"n_{prefix}_years"), agreed(F.col("y")).alias(f"{prefix}_year"))


def audit_links(cohort: DataFrame, citations: DataFrame, ids: DataFrame, years: DataFrame) -> DataFrame:
    """Each paper of the cohort with each of its works and their years.

    ``cohort(PMID, PYEAR)``.  Cardinalities are those of all mappings, taken
    before the cohort narrows them.
    """
    papers = cohort.select(pmid_strict(F.col("PMID")).alias("pmid"), year_strict(F.col("PYEAR")).alias("y")).groupBy("pmid").agg(F.count_distinct("y").alias("n_analysis_years"), F.when(F.min("y") == F.max("y"), F.min("y")).alias("analysis_year"))
    all_ = mappings(ids)
    shared = all_.groupBy("work_id").agg(F.count("*").alias("n_pmids_for_work"))
    mine = all_.join(papers.select("pmid"), "pmid", "left_semi").join(shared, "work_id")
    dois = ids.filter(~is_missing(F.col("pmid"))).select(work_strict(F.col("work_id")).alias("work_id"), doi_norm(F.col("doi")).alias("d")).groupBy("work_id").agg(F.count_distinct("d").alias("n_dois_for_work"), F.when(F.min("d") == F.max("d"), F.min("d")).alias("doi"))
    out = papers.join(agreed_year(citations), "pmid", "left").join(mine, "pmid", "left").join(_work_years(years, "openalex", "work_id", "publication_year"), "work_id", "left").join(dois, "work_id", "left")
    status = F.when(F.col("work_id").isNull(), "unmatched").when(F.col("semmed_year").isNull(), "semmed_year_unavailable").when(F.col("openalex_year").isNull(), "openalex_year_unavailable").when(F.col("openalex_year") == F.col("semmed_year"), "equal").otherwise("different")
    return out.withColumns({"year_difference": F.col("openalex_year") - F.col("semmed_year"), "work_year_status": status})


def audit_papers(links: DataFrame) -> DataFrame:
    """One row for each paper: counts, ``mapping_group`` and ``year_status``."""
    c = F.col
    linked = c("work_id").isNotNull()
    keys = ["pmid", "analysis_year", "n_analysis_years", "semmed_year", "dp_year", "edat_year", "journal_issns", "semmed_rows", "n_semmed_years", "invalid_semmed_year_rows"]
    out = links.groupBy(*keys).agg(
        F.count("work_id").alias("n_works"), F.count_if(linked & c("openalex_year").isNotNull()).alias("n_works_with_usable_year"), F.count_if(linked & c("openalex_year").isNull()).alias("n_works_with_unavailable_year"),
        F.count_if(c("work_year_status") == "equal").alias("n_matching_works"), F.count_if(c("work_year_status") == "different").alias("n_different_year_works"), F.count_distinct("openalex_year").alias("n_distinct_usable_openalex_years"),
        F.min("openalex_year").alias("min_openalex_year"), F.max("openalex_year").alias("max_openalex_year"), F.min("year_difference").alias("min_year_difference"), F.max("year_difference").alias("max_year_difference"),
        F.coalesce(F.bool_or(c("n_pmids_for_work") > 1), F.lit(False)).alias("has_work_shared_with_other_pmids"), F.count("doi").alias("n_works_with_usable_doi"), F.count_distinct("doi").alias("n_distinct_usable_dois"), F.count_if(c("n_dois_for_work") > 1).alias("n_works_with_conflicting_dois"),
    )
    group = F.when(c("n_works") == 0, "unmatched").when(c("n_works") == 1, "single_work").otherwise("multiple_works")
    status = (
        F.when(c("n_works") == 0, "unmatched").when(c("semmed_year").isNull(), "semmed_year_unavailable").when(c("n_works_with_unavailable_year") > 0, "incomplete_openalex_years")
        .when(c("n_matching_works") == c("n_works"), "all_match").when(c("n_matching_works") > 0, "some_match").otherwise("none_match")
    )
    return out.withColumns({"mapping_group": group, "year_status": status, "analysis_semmed_year_equal": c("semmed_year") == c("analysis_year"), "semmed_pyear_dp_equal": c("semmed_year") == c("dp_year")})


def audit_mapping_summary(papers: DataFrame) -> DataFrame:
    return papers.groupBy("mapping_group", "year_status", "has_work_shared_with_other_pmids").agg(F.count("*").alias("n_pmids"), F.sum("n_works").alias("n_pmid_work_links"), F.count_if(F.col("n_different_year_works") > 0).alias("n_pmids_with_any_observed_year_difference"))


def paper_matches(links: DataFrame) -> DataFrame:
    """``pmid, n_works, has_work_shared_with_other_pmids`` as :func:`audit_papers` has them, for callers who need no years and journals."""
    return links.groupBy("pmid").agg(F.count("work_id").alias("n_works"), F.coalesce(F.bool_or(F.col("n_pmids_for_work") > 1), F.lit(False)).alias("has_work_shared_with_other_pmids"))


#: The tables of how papers map to works: overall, by year and by journal.
LEVELS = {"overall": ("mapping_group", "year_status", "has_work_shared_with_other_pmids"), "year": ("analysis_year", "mapping_group", "year_status", "has_work_shared_with_other_pmids"), "issn": ("journal_issns", "mapping_group", "year_status")}


def audit_mapping_levels(papers: DataFrame) -> DataFrame:
    """All levels in one pass by grouping sets; ``level`` tells them apart, a column that a level doesn't have is null."""
    keys = list(dict.fromkeys(k for ks in LEVELS.values() for k in ks))
    out = papers.groupingSets([[F.col(k) for k in ks] for ks in LEVELS.values()], *keys).agg(
        F.grouping("analysis_year").alias("no_year"), F.grouping("journal_issns").alias("no_issn"), F.count("*").alias("n_pmids"), F.sum("n_works").alias("n_pmid_work_links"), F.count_if(F.col("n_different_year_works") > 0).alias("n_pmids_with_any_observed_year_difference"),
    )
    level = F.when(F.col("no_year") == 0, "year").when(F.col("no_issn") == 0, "issn").otherwise("overall")
    return out.select(level.alias("level"), *keys, "n_pmids", "n_pmid_work_links", "n_pmids_with_any_observed_year_difference")


def audit_mapping_by_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy(*LEVELS["year"]).agg(F.count("*").alias("n_pmids"), F.sum("n_works").alias("n_pmid_work_links"), F.count_if(F.col("n_different_year_works") > 0).alias("n_pmids_with_any_observed_year_difference"))


def audit_mapping_by_issn(papers: DataFrame) -> DataFrame:
    return papers.groupBy(*LEVELS["issn"]).agg(F.count("*").alias("n_pmids"))


def cohort_multiplicity_by_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy("analysis_year", "n_works").agg(F.count("*").alias("n_pmids"))


def inspection_work_details(links: DataFrame, sample: DataFrame) -> DataFrame:
    """All links of the papers of an inspection sample."""
    return links.join(sample.select("pmid"), "pmid", "left_semi")


def audit_multiplicity(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """How many works papers have, over all mappings and in the cohort."""
    every = mappings(ids).groupBy("pmid").agg(F.count("*").alias("n_works")).withColumn("scope", F.lit("global_openalex"))
    return every.select("scope", "n_works").union(papers.select(F.lit("cohort"), "n_works")).groupBy("scope", "n_works").agg(F.count("*").alias("n_pmids"), F.sum("n_works").alias("n_pmid_work_links"))


def audit_year_patterns(papers: DataFrame) -> DataFrame:
    return papers.filter("n_works > 1").groupBy("n_works", "n_distinct_usable_openalex_years", "n_works_with_unavailable_year", "year_status").agg(F.count("*").alias("n_pmids"))


def audit_year_difference(links: DataFrame, papers: DataFrame) -> DataFrame:
    return links.filter("year_difference is not null").join(papers.select("pmid", "mapping_group"), "pmid").groupBy("mapping_group", "analysis_year", "year_difference").agg(F.count("*").alias("n_pmid_work_links"), F.count_distinct("pmid").alias("n_pmids"))


def audit_dates(papers: DataFrame) -> DataFrame:
    return papers.groupBy("analysis_year", "semmed_year", "dp_year", "edat_year").agg(F.count("*").alias("n_pmids"))


def audit_doi_patterns(papers: DataFrame) -> DataFrame:
    return papers.filter("n_works > 1").groupBy("n_works", "n_works_with_usable_doi", "n_distinct_usable_dois", "n_works_with_conflicting_dois").agg(F.count("*").alias("n_pmids"))


def inspection_sample(papers: DataFrame, size: int = 20) -> DataFrame:
    """At most ``size`` papers of each stratum with something to look at, in the order of a hash."""
    lo, hi = F.col("min_year_difference"), F.col("max_year_difference")
    stratum = F.when(lo.isNull(), "unavailable").when((lo == hi) & (F.abs(lo) <= 1), lo.cast("string")).otherwise("other_or_mixed")
    odd = (F.col("mapping_group") != "single_work") | (F.col("year_status") != "all_match") | ~F.col("analysis_semmed_year_equal") | ~F.col("semmed_pyear_dp_equal")
    rank = F.row_number().over(Window.partitionBy("mapping_group", "year_status", "stratum").orderBy(F.md5("pmid"), "pmid"))
    return papers.withColumn("stratum", stratum).filter(odd).withColumn("sample_rank", rank).filter(F.col("sample_rank") <= size).select("pmid", "mapping_group", "year_status", "stratum", "n_works", "sample_rank")


def audit_accounting(links: DataFrame, papers: DataFrame) -> DataFrame:
    """Links against what papers promise: rows are the sum of max(1, works), and no paper is lost."""
    a = links.agg(F.count("*").alias("n_links"), F.count_distinct("pmid").alias("n_linked_pmids"))
    b = papers.agg(F.sum(F.greatest(F.lit(1), "n_works")).alias("n_expected_links"), F.count("*").alias("n_pmids"), F.count_distinct("pmid").alias("n_distinct_pmids"))
    both = a.crossJoin(b)  # one row each
    return both.withColumn("passed", (F.col("n_links") == F.col("n_expected_links")) & (F.col("n_linked_pmids") == F.col("n_pmids")) & (F.col("n_pmids") == F.col("n_distinct_pmids")))


def audit3_rows(cohort: DataFrame, citations: DataFrame, ids: DataFrame, years: DataFrame, papers2: DataFrame) -> DataFrame:
    """One row for each paper, year and work with the years of three sources, their differences and ``match_status``."""
    c = F.col
    base = cohort.select(pmid_strict(c("PMID")).alias("pmid"), year_strict(c("PYEAR")).alias("analysis_year")).distinct()
    all_ = mappings(ids)
    out = base.join(all_, "pmid", "left").join(all_.groupBy("pmid").agg(F.count("*").alias("n_works_for_pmid")), "pmid", "left").join(all_.groupBy("work_id").agg(F.count("*").alias("n_pmids_for_work")), "work_id", "left")
    out = out.join(agreed_year(citations).select("pmid", c("semmed_year").alias("semmed_pyear")), "pmid", "left")
    out = out.join(_work_years(years, "openalex", "work_id", "publication_year").select("work_id", "openalex_year"), "work_id", "left").join(_work_years(papers2, "sciscinet", "paperid", "year").select("work_id", "sciscinet_year"), "work_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_works_for_pmid", "n_pmids_for_work")})
    y, o, s = c("semmed_pyear"), c("openalex_year"), c("sciscinet_year")
    status = (
        F.when(y.isNotNull() & (y != c("analysis_year")), "analysis_semmed_year_mismatch").when(c("work_id").isNull(), "no_openalex_mapping").when((c("n_works_for_pmid") > 1) | (c("n_pmids_for_work") > 1), "ambiguous_mapping")
        .when(y.isNull() | o.isNull() | s.isNull(), "missing_or_conflicting_year").when((y == o) & (o == s), "all_equal").when(o == s, "openalex_sciscinet_equal").when(y == o, "semmed_openalex_equal").when(y == s, "semmed_sciscinet_equal").otherwise("all_different")
    )
    return out.withColumns({"delta_semmed_analysis": y - c("analysis_year"), "delta_openalex_semmed": o - y, "delta_sciscinet_semmed": s - y, "delta_sciscinet_openalex": s - o, "match_status": status})


def audit3_status_by_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy("analysis_year", "match_status").agg(F.count("*").alias("n_rows"), F.count_distinct("pmid").alias("n_pmids"), F.count_distinct("work_id").alias("n_works"))


def audit3_differences(rows: DataFrame) -> DataFrame:
    """How often each difference occurs; but for the first kind, over one-to-one mappings only."""
    kinds = ("semmed_analysis", "openalex_semmed", "sciscinet_semmed", "sciscinet_openalex")
    clean = (F.col("n_works_for_pmid") == 1) & (F.col("n_pmids_for_work") == 1)
    cells = F.array(*[F.struct(F.lit(k).alias("comparison"), F.when(F.lit(True) if k == kinds[0] else clean, F.col(f"delta_{k}")).alias("year_difference")) for k in kinds])
    return rows.select("pmid", "analysis_year", F.explode(cells).alias("c")).select("pmid", "analysis_year", "c.*").filter("year_difference is not null").groupBy("comparison", "analysis_year", "year_difference").agg(F.count_distinct("pmid").alias("n_pmids"))


def linked_papers(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Every source paper, with its PMID if its work has exactly one."""
    per = mappings(ids).groupBy("work_id").agg(F.count("*").alias("n_pmids"), F.min("pmid").alias("PMID"))
    work = work_strict(F.col("paperid"))
    return papers.withColumn("work_id", work).join(per.filter("n_pmids = 1").select("work_id", "PMID"), "work_id", "left").drop("work_id")


def rejected_mappings(ids: DataFrame) -> DataFrame:
    """Distinct mappings that aren't used, with the reason."""
    p, w = pmid_strict(F.col("pmid")), work_strict(F.col("work_id"))
    rows = ids.filter(~is_missing(F.col("pmid"))).select(F.trim("work_id").alias("raw_work_id"), F.trim("pmid").alias("raw_pmid"), p.alias("p"), w.alias("w")).distinct()
    many = rows.filter("p is not null and w is not null").groupBy("w").agg(F.count_distinct("p").alias("k")).filter("k > 1").select("w", F.lit(True).alias("many"))
    reason = F.when(F.col("p").isNull() & F.col("w").isNull(), "invalid_pmid_and_work_id").when(F.col("p").isNull(), "invalid_pmid").when(F.col("w").isNull(), "invalid_work_id").when(F.col("many"), "work_with_many_pmids")
    return rows.join(many, "w", "left").withColumn("reason", reason).filter("reason is not null").select("raw_work_id", "raw_pmid", "reason")


def link_summary(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of what linking found."""
    linked = linked_papers(papers, ids)
    a = linked.agg(F.count("*").alias("n_papers"), F.count("PMID").alias("n_linked_papers"), F.count_distinct("PMID").alias("n_linked_pmids"))
    b = mappings(ids).groupBy("pmid").agg(F.count("*").alias("k")).agg(F.count("*").alias("n_mapped_pmids"), F.count_if(F.col("k") > 1).alias("n_pmids_with_many_works"), F.sum("k").alias("n_mappings"))
    d = rejected_mappings(ids).agg(F.count("*").alias("n_rejected_mappings"))
    return a.crossJoin(b).crossJoin(d).withColumn("share_linked_papers", share(F.col("n_linked_papers"), F.col("n_papers")))  # one row each
