"""Who reuses whose new statements: papers, and statements found in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import share
from ..functions.windows import year_bounds
from ..sources.shared import written
from .annotate import NEW
from .papers import KINDS

TRIPLE = ("s", "p", "o")
#: Later rows of a triple that go to one part, and frequent triples that may be broadcast.
LATER_ROWS, MANY_TRIPLES = 10_000, 100_000


def _focal_new(annotated: DataFrame, w: int, last: int | None) -> DataFrame:
    last = year_bounds(annotated, "PYEAR")[1] if last is None else last
    return annotated.filter(F.col("edge_annotation").isin(*NEW) & (F.col("PYEAR") <= F.lit(last) - w) & F.col("p").isNotNull()).select(F.col("PMID").alias("focal_pmid"), F.col("PYEAR").alias("focal_year"), *TRIPLE, "edge_annotation").distinct()


def _matched(annotated: DataFrame, w: int, last: int | None) -> DataFrame:
    """Each (focal paper, later paper, triple) where the later paper repeats the triple within ``w`` years.

    Later papers of a triple are dealt to parts of about LATER_ROWS, and its
    focal papers go to each of them, so that no task has all pairs of a
    frequent triple.
    """
    later = annotated.select(F.col("PMID").alias("adopter_pmid"), F.col("PYEAR").alias("adopter_year"), *TRIPLE).distinct()
    parts = annotated.groupBy(*TRIPLE).agg(F.ceil(F.count("*") / LATER_ROWS).alias("parts")).filter("parts > 1")
    many = written(parts)
    many = F.broadcast(many) if many.count() <= MANY_TRIPLES else many
    dealt = lambda df: df.join(many, list(TRIPLE), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    later = dealt(later).withColumn("part", F.pmod(F.xxhash64("adopter_pmid"), F.col("parts"))).drop("parts")
    focal = dealt(_focal_new(annotated, w, last)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    return focal.join(later, [*TRIPLE, "part"]).drop("part").filter((F.col("adopter_year") > F.col("focal_year")) & (F.col("adopter_year") <= F.col("focal_year") + w))


def paper_network_edges(annotated: DataFrame, w: int = 5, last: int | None = None) -> DataFrame:
    """Adopter to focal paper, with how many new triples they share; the output itself is a row for each pair."""
    own = lambda c: F.count_if(F.col("edge_annotation") == c)
    edges = _matched(annotated, w, last).groupBy("adopter_pmid", "focal_pmid", "adopter_year", "focal_year").agg(*[own(c).alias(f"n_shared_{k}_triples") for c, k in zip(NEW, KINDS, strict=False)], F.count("*").alias("n_shared_new_triples"))
    return edges.withColumn("year_gap", F.col("adopter_year") - F.col("focal_year"))


def _later_counts(annotated: DataFrame, w: int, last: int | None) -> tuple[DataFrame, DataFrame]:
    """Focal papers of each new triple and year, and papers that repeat it later."""
    focal = _focal_new(annotated, w, last).groupBy("focal_year", *TRIPLE).agg(F.count("*").alias("n_focal_pmids"))
    per_year = annotated.select("PMID", F.col("PYEAR").alias("y"), *TRIPLE).distinct().groupBy(*TRIPLE, "y").agg(F.count("*").alias("n"))
    later = focal.join(per_year, list(TRIPLE)).filter((F.col("y") > F.col("focal_year")) & (F.col("y") <= F.col("focal_year") + w)).groupBy("focal_year", *TRIPLE).agg(F.sum("n").alias("n_future_pmids"))
    return focal, later


def paper_network_trace(annotated: DataFrame, w: int = 5, last: int | None = None) -> DataFrame:
    """New focal occurrences and the later occurrences that match them."""
    focal, _ = _later_counts(annotated, w, last)
    rows = annotated.select("PMID", "PYEAR", *TRIPLE, "edge_annotation").distinct()
    names = ["focal_year", "role", "PMID", "PYEAR", *TRIPLE, "annotation", "n_focal_pmids"]
    own = rows.filter(F.col("edge_annotation").isin(*NEW)).join(focal.withColumn("PYEAR", F.col("focal_year")), ["PYEAR", *TRIPLE]).withColumn("role", F.lit("focal_new"))
    later = rows.join(focal, list(TRIPLE)).filter((F.col("PYEAR") > F.col("focal_year")) & (F.col("PYEAR") <= F.col("focal_year") + w)).withColumn("role", F.lit("future_matched"))
    return own.withColumnRenamed("edge_annotation", "annotation").select(names).union(later.withColumnRenamed("edge_annotation", "annotation").select(names))


def paper_network_profile(annotated: DataFrame, w: int = 5, last: int | None = None) -> DataFrame:
    """Sizes for each focal year, without expanding any pair; products in decimals."""
    focal, later = _later_counts(annotated, w, last)
    met = focal.join(later, ["focal_year", *TRIPLE], "left")
    product = (F.col("n_focal_pmids").cast("decimal(19,0)") * F.col("n_future_pmids").cast("decimal(19,0)")).cast("decimal(38,0)")
    sizes = met.groupBy("focal_year").agg(
        F.sum("n_focal_pmids").alias("n_new_triple_pmid_rows"), F.count("*").alias("n_unique_new_triples"), F.coalesce(F.sum("n_future_pmids"), F.lit(0)).alias("n_matched_future_triple_pmid_rows"),
        F.coalesce(F.sum(product), F.lit(0)).cast("bigint").alias("n_triple_paper_pair_occurrences"), F.max("n_focal_pmids").alias("max_focal_pmids_per_triple"), F.coalesce(F.max("n_future_pmids"), F.lit(0)).alias("max_future_pmids_per_triple"),
    )
    papers = annotated.groupBy(F.col("PYEAR").alias("focal_year")).agg(F.count_distinct("PMID").alias("n_focal_pmids"))
    return sizes.join(papers, "focal_year")


def paper_network_nodes(annotated: DataFrame, adoption: DataFrame, edges: DataFrame, w: int = 5, bounds: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Every annotated paper, isolated ones too, with its adoption and degrees."""
    first, last = bounds or year_bounds(annotated, "PYEAR")
    end, y = (last or 0) - w, F.col("PYEAR")
    counts = annotated.groupBy("PMID", "PYEAR").agg(F.count("*").alias("n_triples"), *[F.count_if(F.col("edge_annotation") == c).alias(f"n_{k}") for c, k in zip(NEW, KINDS, strict=False)], F.count_if(F.col("edge_annotation").isin(*NEW)).alias("n_new_triples"))
    adopted = [f"n_{k}_adopted" for k in KINDS[:3]] + ["n_new_triples_adopted", "has_new_triples_adopted"]
    out = counts.join(adoption.select("PMID", *adopted), "PMID", "left")
    degree = lambda side, name: edges.groupBy(F.col(side).alias("PMID")).agg(F.count("*").alias(f"{name}_degree"), F.sum("n_shared_new_triples").alias(f"{name}_strength"))
    out = out.join(degree("focal_pmid", "in"), "PMID", "left").join(degree("adopter_pmid", "out"), "PMID", "left")
    status = F.when(y > end, "target_only").when(F.col("n_new_triples") == 0, "no_new_triples").when(F.col("n_new_triples_adopted") == 0, "new_triples_not_adopted").otherwise("new_triples_adopted")
    out = out.withColumns({
        "focal_eligible": y <= end, "adopter_eligible": y > first, "has_complete_followup": y <= end, "has_complete_focal_coverage": (y >= (first or 0) + w) & (y <= end + 1), "focal_status": status,
        **{c: F.when(y <= end, F.col(c)) for c in adopted}, **{f"{s}_{k}": F.coalesce(f"{s}_{k}", F.lit(0)) for s in ("in", "out") for k in ("degree", "strength")},
    })
    return out


def paper_network_summary(edges: DataFrame, years: DataFrame) -> DataFrame:
    """A row for each of ``years(focal_year)``, those without edges too."""
    per = edges.groupBy("focal_year").agg(F.count("*").alias("n_edges"), F.sum("n_shared_new_triples").alias("total_shared_new_triples"), F.count_distinct("focal_pmid").alias("n_focal_pmids_with_incoming_edges"), F.count_distinct("adopter_pmid").alias("n_adopter_pmids"))
    out = years.join(per, "focal_year", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in per.columns if c != "focal_year"})


def network_checks(edges: DataFrame, nodes: DataFrame, profile: DataFrame, w: int = 5) -> DataFrame:
    """Violations of what must hold between edges and nodes, a row for each rule."""
    one = lambda rule, df: df.select(F.lit(rule).alias("rule"), F.col("n").alias("n_violations"))
    parts = F.col("n_shared_new_node_triples") + F.col("n_shared_new_combination_triples") + F.col("n_shared_new_relation_triples")
    bad_edges = edges.agg(
        F.count_if(~F.col("year_gap").between(1, w)).alias("gap"), F.count_if(parts != F.col("n_shared_new_triples")).alias("weights"), F.count_if(F.col("adopter_pmid") == F.col("focal_pmid")).alias("self"),
        (F.count("*") - F.count_distinct("adopter_pmid", "focal_pmid")).alias("repeated"), F.coalesce(F.sum("n_shared_new_triples"), F.lit(0)).alias("total"),
    )
    rules = {"year gap out of the window": "gap", "weights don't add up": "weights", "edge to itself": "self", "repeated pair": "repeated"}
    out = bad_edges.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("bigint").alias("n_violations")) for r, c in rules.items()])).alias("x")).select("x.*")
    total = bad_edges.join(profile.agg(F.coalesce(F.sum("n_triple_paper_pair_occurrences"), F.lit(0)).alias("expected"))).select(F.abs(F.col("total") - F.col("expected")).cast("bigint").alias("n"))
    degree = nodes.filter("focal_eligible").agg(F.count_if((F.col("in_degree") > 0) != (F.coalesce("has_new_triples_adopted", F.lit(0)) == 1)).cast("bigint").alias("n"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("focal_pmid").alias("PMID"), F.col("focal_year").alias("PYEAR")), F.struct(F.col("adopter_pmid").alias("PMID"), F.col("adopter_year").alias("PYEAR")))).alias("e")).select("e.*")
    lost = ends.join(nodes.select("PMID", "PYEAR"), ["PMID", "PYEAR"], "left_anti").agg(F.count("*").cast("bigint").alias("n"))
    both = edges.select(F.col("focal_pmid").alias("PMID"), F.col("focal_year").alias("y")).intersect(edges.select(F.col("adopter_pmid"), F.col("adopter_year"))).filter("y is null").agg(F.count("*").cast("bigint").alias("n"))
    return out.union(one("total weight differs from the profile", total)).union(one("in-degree and adoption disagree", degree)).union(one("end of an edge isn't a node", lost)).union(one("paper without a year on both sides", both))


def parallel_triples(annotated: DataFrame) -> DataFrame:
    """New triples of each year with how many papers report them."""
    return annotated.filter(F.col("edge_annotation").isin(*NEW)).groupBy("PYEAR", "edge_annotation", *TRIPLE).agg(F.count("*").alias("n_rows"), F.count_distinct("PMID").alias("n_pmids"))


def _parallel(annotated: DataFrame, keys: list[str]) -> DataFrame:
    per = annotated.filter(F.col("edge_annotation").isin(*NEW)).groupBy(*keys, *TRIPLE).agg(F.count("*").alias("rows"), F.count_distinct("PMID").alias("pmids"))
    papers = annotated.filter(F.col("edge_annotation").isin(*NEW)).groupBy(*keys).agg(F.count_distinct("PMID").alias("n_unique_pmids"))
    many = F.col("pmids") > 1
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = per.groupBy(*keys).agg(
        F.sum("rows").alias("n_rows"), F.count("*").alias("n_unique_exact_triples"), F.count_if(~many).alias("n_single_pmid_exact_triples"), F.count_if(many).alias("n_multi_pmid_exact_triples"),
        zero(F.sum(F.when(~many, F.col("rows")))).alias("n_rows_in_single_pmid_exact_triples"), zero(F.sum(F.when(many, F.col("rows")))).alias("n_rows_in_multi_pmid_exact_triples"),
    ).join(papers, keys)
    return out.withColumns({"share_multi_pmid_exact_triples": share(F.col("n_multi_pmid_exact_triples"), F.col("n_unique_exact_triples")), "share_rows_in_multi_pmid_exact_triples": share(F.col("n_rows_in_multi_pmid_exact_triples"), F.col("n_rows"))})


def parallel_by_year_category(annotated: DataFrame) -> DataFrame:
    return _parallel(annotated, ["PYEAR", "edge_annotation"])


def parallel_by_year(annotated: DataFrame) -> DataFrame:
    """All new categories together, recounted."""
    return _parallel(annotated, ["PYEAR"]).withColumn("edge_annotation", F.lit("Pooled_New_Knowledge"))


def parallel_top_triples(annotated: DataFrame, top: int = 20, examples: int = 20) -> DataFrame:
    """The triples of a year and category that most papers report, with some of their papers."""
    order = Window.partitionBy("PYEAR", "edge_annotation").orderBy(F.desc("n_pmids"), F.desc("n_rows"), "s", "p", "o")
    best = parallel_triples(annotated).filter("n_pmids > 1").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    number = F.col("PMID").try_cast("bigint")
    papers = annotated.join(best.select("PYEAR", "edge_annotation", *TRIPLE), ["PYEAR", "edge_annotation", *TRIPLE]).select("PYEAR", "edge_annotation", *TRIPLE, "PMID").distinct()
    nth = F.row_number().over(Window.partitionBy("PYEAR", "edge_annotation", *TRIPLE).orderBy(number.asc_nulls_last(), "PMID"))
    named = papers.withColumn("k", nth).filter(F.col("k") <= examples).groupBy("PYEAR", "edge_annotation", *TRIPLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "PMID"))), lambda x: x["PMID"]), ";").alias("example_pmids"))
    return best.join(named, ["PYEAR", "edge_annotation", *TRIPLE])
