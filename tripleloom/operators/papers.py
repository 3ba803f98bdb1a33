"""Paper metrics: novelty, patterns, adoption, decomposition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import pattern_label, share
from ..functions.quantiles import with_quantiles
from .annotate import CATEGORIES, NEW

KINDS = ("new_node", "new_combination", "new_relation", "repeated_triple")
#: Statements whose concepts, pairs and triples one task tells apart.
TASK_ROWS = 100_000
PATTERNS = ("Repeated_Only", "N", "C", "R", "N+C", "N+R", "C+R", "N+C+R")
ADOPTION_RATIOS = (
    ("share_new_node_adopted", "n_new_node_adopted", "n_new_node"),
    ("share_new_combination_adopted", "n_new_combination_adopted", "n_new_combination"),
    ("share_new_relation_adopted", "n_new_relation_adopted", "n_new_relation"),
    ("share_new_triples_adopted", "n_new_triples_adopted", "n_new_triples"),
    ("share_repeated_triple_continued", "n_repeated_triple_continued", "n_repeated_triple"),
    ("share_triples_reappeared", "n_triples_reappeared", "n_triples"),
    ("share_adopted_new_triples_in_all", "n_new_triples_adopted", "n_triples"),
)
ADOPTION_FLAGS = ("new_node_adopted", "new_combination_adopted", "new_relation_adopted", "new_triples_adopted", "repeated_triple_continued", "triples_reappeared")


def _counts() -> list:
    kind = F.col("edge_annotation")
    return [F.count("*").alias("n_triples"), *[F.count_if(kind == c).alias(f"n_{k}") for c, k in zip(CATEGORIES, KINDS, strict=True)], F.count_if(kind != CATEGORIES[3]).alias("n_new_triples")]


def _shares(of: str = "n_triples") -> dict:
    return {f"share_{k}": share(F.col(f"n_{k}"), F.col(of)) for k in (*KINDS, "new_triples")}


def paper_annotation_metrics(annotated: DataFrame) -> DataFrame:
    """16 columns for each paper."""
    out = annotated.groupBy("PMID", "PYEAR").agg(*_counts()).withColumns(_shares())
    return out.withColumns({f"share_{k}_among_new": share(F.col(f"n_{k}"), F.col("n_new_triples")) for k in KINDS[:3]})


def paper_pattern(metrics: DataFrame) -> DataFrame:
    """Which kinds of new knowledge each paper has."""
    has = [F.col(f"n_{k}") > 0 for k in KINDS[:3]]
    return metrics.select(
        "PMID", "PYEAR", *[h.cast("int").alias(f"has_{k}") for h, k in zip(has, KINDS, strict=False)], (F.col("n_new_triples") > 0).cast("int").alias("has_new_triples"),
        sum(h.cast("int") for h in has).alias("n_new_knowledge_types"), pattern_label(*has).alias("knowledge_type_pattern"),
    )


def pattern_summary(metrics: DataFrame) -> DataFrame:
    """All eight patterns for each year, absent ones too."""
    per = paper_pattern(metrics).join(metrics.select("PMID", "PYEAR", "n_triples"), ["PMID", "PYEAR"])
    counted = per.groupBy("PYEAR", "knowledge_type_pattern").agg(F.count("*").alias("n"), F.avg("n_triples").alias("mean_n_triples"))
    counted = with_quantiles(counted, per, ["PYEAR", "knowledge_type_pattern"], ["n_triples"], [0.5]).withColumn("median_n_triples", F.get("n_triples_q", F.lit(0))).drop("n_triples_q")
    years = per.groupBy("PYEAR").agg(F.count("*").alias("n_year")).select("PYEAR", "n_year", F.explode(F.array(*map(F.lit, PATTERNS))).alias("knowledge_type_pattern"))
    n = F.coalesce("n", F.lit(0))
    return years.join(counted, ["PYEAR", "knowledge_type_pattern"], "left").select("PYEAR", "knowledge_type_pattern", n.alias("n_pmids"), share(n, F.col("n_year")).alias("share_pmids"), "mean_n_triples", "median_n_triples")


def _new_knowledge(annotated: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct concepts, pairs and triples of each ``scope``, in one pass.

    Rows are dealt by paper, where there is one, to as many tasks as their number asks for, and their values meet there only.
    """
    rows = annotated.dropna(subset=scope).select(*scope, "s", "p", "o", "node_a", "node_b", "edge_annotation", "subject_seen_in_prior_window", "object_seen_in_prior_window")
    kind, none = F.col("edge_annotation"), F.lit(None).cast("string")

    def cell(what: int, label, x: str, y=none, z=none):
        return F.struct(F.lit(what).alias("what"), label.cast("string").alias("label"), F.col(x).alias("x"), y.alias("y"), z.alias("z"))

    cells = F.array(
        cell(0, ~F.col("subject_seen_in_prior_window"), "s"), cell(0, ~F.col("object_seen_in_prior_window"), "o"),
        cell(1, kind == NEW[1], "node_a", F.col("node_b")), cell(2, kind, "s", F.col("o"), F.col("p")),
    )
    if "PMID" in scope:
        rows = rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(annotated.count() / TASK_ROWS)), "PMID")
    once = rows.select(*scope, F.explode(cells).alias("e")).select(*scope, "e.*").distinct()
    what, label = F.col("what"), F.col("label")
    return once.groupBy(*scope).agg(
        F.count_if(what == 0).alias("n_unique_concepts"), F.count_if((what == 0) & (label == "true")).alias("n_unique_new_concepts"),
        F.count_if(what == 1).alias("n_unique_concept_pairs"), F.count_if((what == 1) & (label == "true")).alias("n_unique_new_combination_pairs"),
        F.count_if(what == 2).alias("n_triples"), *[F.count_if((what == 2) & (label == c)).alias(f"n_{k}") for c, k in zip(CATEGORIES, KINDS, strict=True)], F.count_if((what == 2) & (label != CATEGORIES[3])).alias("n_new_triples"),
    )


def _knowledge_shares(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "share_unique_new_concepts": share(F.col("n_unique_new_concepts"), F.col("n_unique_concepts")),
        "share_unique_new_combination_pairs": share(F.col("n_unique_new_combination_pairs"), F.col("n_unique_concept_pairs")),
    } | _shares())


def paper_new_knowledge(annotated: DataFrame) -> DataFrame:
    """Distinct concepts, pairs and triples of each paper, and the new ones among them."""
    return _knowledge_shares(_new_knowledge(annotated, ["PMID", "PYEAR"]))


def year_new_knowledge(annotated: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """The same for each year, counted once across its papers; ``years(PYEAR)`` adds empty years with counts of 0."""
    out = _new_knowledge(annotated, ["PYEAR"])
    if years is not None:
        out = years.join(out, "PYEAR", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in out.columns if c.startswith("n_")})
    return _knowledge_shares(out)


def paper_adoption_metrics(transitions: DataFrame) -> DataFrame:
    """27 columns for each paper of the transition years."""
    kind, state = F.col("edge_annotation"), F.col("future_five_year_transition")
    out = transitions.groupBy("PMID", "PYEAR").agg(
        *_counts(), *[F.count_if((kind == c) & (state == "Adopted")).alias(f"n_{k}_adopted") for c, k in zip(NEW, KINDS, strict=False)],
        F.count_if(state == "Adopted").alias("n_new_triples_adopted"), F.count_if(state == "Continued").alias("n_repeated_triple_continued"), F.count_if("future_exact_triple_seen").alias("n_triples_reappeared"),
    )
    out = out.withColumns({s: share(F.col(n), F.col(d)) for s, n, d in ADOPTION_RATIOS})
    return out.withColumns({f"has_{k}": (F.col(f"n_{k}") > 0).cast("int") for k in ADOPTION_FLAGS})


def adoption_summary(metrics: DataFrame) -> DataFrame:
    sums = [c for c in metrics.columns if c.startswith("n_")]
    return metrics.groupBy("PYEAR").agg(F.sum("n_triples").alias("n_input_triples"), F.count("*").alias("n_pmids"), *[F.count_if(F.col(f"has_{k}") == 1).alias(f"n_pmids_has_{k}") for k in ADOPTION_FLAGS], *[F.sum(c).alias(c) for c in sums])


def adoption_decomposition(metrics: DataFrame) -> DataFrame:
    """share_new x share_new_adopted = share_adopted_new_in_all."""
    return metrics.select(
        "PMID", "PYEAR", "n_triples", "n_new_triples", "n_new_triples_adopted", share(F.col("n_new_triples"), F.col("n_triples")).alias("share_new_triples"),
        "share_new_triples_adopted", "share_adopted_new_triples_in_all",
    )


def decomposition_summary(decomposed: DataFrame) -> DataFrame:
    shares = ("share_new_triples", "share_new_triples_adopted", "share_adopted_new_triples_in_all")
    sums = {c: F.sum(c) for c in ("n_triples", "n_new_triples", "n_new_triples_adopted")}
    out = decomposed.groupBy("PYEAR").agg(
        F.count("*").alias("n_pmids"), F.count_if(F.col("n_new_triples") > 0).alias("n_pmids_with_new_triples"), F.count_if(F.col("n_new_triples") == 0).alias("n_pmids_without_new_triples"),
        F.count_if(F.col("n_new_triples_adopted") > 0).alias("n_pmids_with_adopted_new_triples"), *[v.alias(f"sum_{c}") for c, v in sums.items()],
        *[F.avg(s).alias(f"mean_{s}") for s in shares],
        share(sums["n_new_triples"], sums["n_triples"]).alias("pooled_share_new_triples"), share(sums["n_new_triples_adopted"], sums["n_new_triples"]).alias("pooled_share_new_triples_adopted"),
        share(sums["n_new_triples_adopted"], sums["n_triples"]).alias("pooled_share_adopted_new_triples_in_all"),
    )
    out = with_quantiles(out, decomposed, ["PYEAR"], shares, [0.5])
    return out.withColumns({f"median_{s}": F.get(f"{s}_q", F.lit(0)) for s in shares}).drop(*[f"{s}_q" for s in shares])
