"""From raw statements to prepared triples, with an account of every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import component_count, is_missing, passes_novelty, primary_component, share
from ..sources.tables import numbered

#: The columns of prepared triples.
PREPARED = ("PREDICATION_ID", "SENTENCE_ID", "PMID", "PYEAR", "PREDICATE", "SUBJECT_CUI", "SUBJECT_NAME", "SUBJECT_SEMTYPE", "SUBJECT_NOVELTY", "subject_cui_primary", "subject_name_primary", "OBJECT_CUI", "OBJECT_NAME", "OBJECT_SEMTYPE", "OBJECT_NOVELTY", "object_cui_primary", "object_name_primary")
TRIPLE_KEY = ("PMID", "subject_cui_primary", "PREDICATE", "object_cui_primary")


def with_keys(raw: DataFrame, citations: DataFrame) -> DataFrame:
    """Raw rows with year, primary components, and whether they pass and miss a key.

    A paper with several years in ``citations`` gets its least one.
    """
    years = citations.filter(~is_missing(F.col("PMID"))).groupBy("PMID").agg(F.min(F.nullif(F.trim("PYEAR"), F.lit(""))).alias("PYEAR"))
    out = raw.join(years, "PMID", "left")
    out = out.withColumns({f"{side.lower()}_{part}_primary": primary_component(F.col(f"{side}_{part.upper()}")) for side in ("SUBJECT", "OBJECT") for part in ("cui", "name")})
    missing = is_missing(F.col("PMID")) | F.col("PYEAR").isNull() | is_missing(F.col("PREDICATE")) | F.col("subject_cui_primary").isNull() | F.col("object_cui_primary").isNull()
    return out.withColumns({"passes_novelty": passes_novelty(F.col("SUBJECT_NOVELTY"), F.col("OBJECT_NOVELTY")), "missing_key": F.coalesce(missing, F.lit(True))})


def dedup_first(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; one partial aggregate, no sort."""
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(whole, F.col(order)).alias("__first")).select(*keys, "__first.*").select(*rows.columns)


#: What profiles count of a statement.
PROFILED = ("PYEAR", *TRIPLE_KEY, "subject_name_primary", "object_name_primary")


def first_triples(rows: DataFrame) -> DataFrame:
    """Each triple of a paper once, with the columns that ``rows`` have of its first statement."""
    return dedup_first(rows, TRIPLE_KEY, "source_order").drop("source_order")


def prepare_triples(raw: DataFrame, citations: DataFrame) -> DataFrame:
    """17 columns: rows that pass the novelty filter and have all keys, each triple of a paper once."""
    good = with_keys(raw, citations).filter(F.col("passes_novelty") & ~F.col("missing_key"))
    return dedup_first(good.select(*PREPARED, "source_order"), TRIPLE_KEY, "source_order").select(*PREPARED)


def prepare_diagnostics(raw: DataFrame, citations: DataFrame) -> DataFrame:
    """One row of 50 counts and shares: one aggregate for each stage."""
    rows = with_keys(raw, citations)
    passed, col = F.col("passes_novelty"), F.col
    cit = citations.groupBy("PMID").agg(F.count("*").alias("n"), F.count_distinct("PYEAR").alias("y"))
    has = col("PMID").isNotNull()
    a = cit.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_citation_rows"), F.count_if(has).alias("n_unique_citation_pmids"), F.count_if(has & (col("n") > 1)).alias("n_duplicate_citation_pmids"), F.count_if(has & (col("y") > 1)).alias("n_conflicting_citation_pyear_pmids"),
    ).withColumn("n_duplicate_citation_rows", col("n_citation_rows") - col("n_unique_citation_pmids"))
    score = {s: col(f"{s.upper()}_NOVELTY").try_cast("double") for s in ("subject", "object")}
    pipe = lambda c: passed & F.coalesce(F.contains(col(c), F.lit("|")), F.lit(False))
    counts = {
        "n_raw_predication_rows": F.count("*"), "n_unique_raw_predication_ids": F.count_distinct("PREDICATION_ID"), "n_unique_raw_pmids": F.count_distinct("PMID"),
        "n_rows_missing_pmid": F.count_if(is_missing(col("PMID"))), "n_rows_missing_predication_id": F.count_if(is_missing(col("PREDICATION_ID"))),
        "n_rows_with_pyear": F.count("PYEAR"), "n_rows_missing_pyear": F.count_if(col("PYEAR").isNull()), "min_pyear_with_pyear": F.min(col("PYEAR").try_cast("int")), "max_pyear_with_pyear": F.max(col("PYEAR").try_cast("int")),
        "n_rows_after_novelty_filter": F.count_if(passed), "n_rows_removed_by_novelty_filter": F.count_if(~passed),
        **{f"n_rows_missing_{s}_novelty": F.count_if(v.isNull()) for s, v in score.items()}, **{f"n_rows_zero_{s}_novelty": F.count_if(v == 0) for s, v in score.items()},
        "n_rows_missing_required_analytic_key": F.count_if(passed & col("missing_key")), "n_rows_valid_for_analytic_key": F.count_if(passed & ~col("missing_key")),
        **{f"n_{s}_{p}_pipe_delimited_rows": F.count_if(pipe(f"{s.upper()}_{p.upper()}")) for p in ("cui", "name") for s in score},
        **{f"n_{s}_cui_name_component_mismatch_rows": F.count_if(passed & (component_count(col(f"{s.upper()}_CUI")) != component_count(col(f"{s.upper()}_NAME")))) for s in score},
        **{f"n_missing_{s}_{p}_primary": F.count_if(passed & col(f"{s}_{p}_primary").isNull()) for p in ("cui", "name") for s in score},
    }
    b = rows.agg(*[v.alias(k) for k, v in counts.items()])
    groups = rows.filter(passed & ~col("missing_key")).groupBy(*TRIPLE_KEY, "PYEAR").agg(F.count("*").alias("n"))
    more = col("n") > 1
    c = groups.agg(
        F.count("*").alias("n_pmid_exact_triple_groups_before_dedup"), F.count_if(more).alias("n_duplicate_pmid_exact_triple_groups"), F.coalesce(F.sum(F.when(more, col("n"))), F.lit(0)).alias("n_rows_in_duplicate_pmid_exact_triple_groups"),
        F.coalesce(F.sum(F.when(more, col("n") - 1)), F.lit(0)).alias("n_rows_removed_by_pmid_exact_triple_dedup"), F.count("*").alias("n_final_pmid_unique_triples"), F.count_distinct("PMID").alias("n_final_unique_pmids"),
        F.count_distinct("PREDICATE").alias("n_final_unique_predicates"), F.count_distinct("subject_cui_primary").alias("n_final_unique_subject_cui_primary"), F.count_distinct("object_cui_primary").alias("n_final_unique_object_cui_primary"),
        F.min(col("PYEAR").try_cast("int")).alias("min_pyear_final"), F.max(col("PYEAR").try_cast("int")).alias("max_pyear_final"), F.count_if(col("subject_cui_primary") == col("object_cui_primary")).alias("n_self_loop_triples_final"),
    )
    d = groups.select(F.explode(F.array("subject_cui_primary", "object_cui_primary")).alias("c")).agg(F.count_distinct("c").alias("n_final_unique_cui_primary"))
    out = a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each
    return out.withColumns({
        "share_rows_missing_pyear": share(col("n_rows_missing_pyear"), col("n_raw_predication_rows")), "share_rows_after_novelty_filter": share(col("n_rows_after_novelty_filter"), col("n_raw_predication_rows")),
        "share_rows_missing_required_analytic_key": share(col("n_rows_missing_required_analytic_key"), col("n_rows_after_novelty_filter")),
        "share_rows_removed_by_pmid_exact_triple_dedup": share(col("n_rows_removed_by_pmid_exact_triple_dedup"), col("n_rows_valid_for_analytic_key")), "share_self_loop_triples_final": share(col("n_self_loop_triples_final"), col("n_final_pmid_unique_triples")),
    })


def analysis_sample(prepared: DataFrame, bad_years: Sequence[str], bad_predicates: Sequence[str]) -> DataFrame:
    """Rows of other years and predicates; a null of either is left out."""
    return prepared.filter(~F.col("PYEAR").isin(*bad_years) & ~F.col("PREDICATE").isin(*bad_predicates))


def analysis_sample_counts(prepared: DataFrame, bad_years: Sequence[str], bad_predicates: Sequence[str]) -> DataFrame:
    """One row: rows before and after, and why rows were left out."""
    y, p = F.col("PYEAR").isin(*bad_years), F.col("PREDICATE").isin(*bad_predicates)
    keep = F.coalesce(~y & ~p, F.lit(False))
    return prepared.agg(
        F.count("*").alias("n_rows_before"), F.count_if(y).alias("n_rows_bad_year"), F.count_if(p).alias("n_rows_bad_predicate"), F.count_if(y & p).alias("n_rows_bad_both"), F.count_if(keep).alias("n_rows_after"),
        F.count_distinct("PMID").alias("n_pmids_before"), F.count_distinct(F.when(keep, F.col("PMID"))).alias("n_pmids_after"),
    )


def split_by_year_counts(prepared: DataFrame) -> DataFrame:
    """Rows of each year, the reconciliation of a table written by year."""
    return prepared.groupBy("PYEAR").agg(F.count("*").alias("n_rows"), F.count_distinct("PMID").alias("n_pmids"))


def shard_manifest(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Contiguous shards of ``rows`` rows by ``order``, the last one shorter: shard, n_rows, first and last key; nothing but the manifest is kept."""
    return numbered(df, [order]).withColumn("shard", F.ceil(F.col("number") / rows)).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min(order).alias("first_key"), F.max(order).alias("last_key"))


def filter_linked_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_missing(F.col("pmid")))
