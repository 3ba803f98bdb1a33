"""What later papers build on new concepts and new pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import share
from ..functions.windows import year_bounds
from .annotate import NEW

PATHS = ("nn_future_nc", "nn_future_nr", "nn_future_any", "nc_future_nr")
DEVELOPED = ("nn_dev_neither", "nn_dev_nc_only", "nn_dev_nr_only", "nn_dev_both")
JOINT = tuple(f"{k}_{s}" for k in ("nn", "nc") for s in ("neither_adopted_nor_developed", "adopted_only", "developed_only", "adopted_and_developed"))
PAIR = "nc_pairs_future_nr"
KEY = ("PMID", "PYEAR", "s", "p", "o")


def _focal(annotated: DataFrame, w: int, last: int | None) -> DataFrame:
    """Annotated rows whose ``w`` following years, up to ``last``, are annotated as well."""
    last = year_bounds(annotated, "PYEAR")[1] if last is None else last
    return annotated.filter(F.col("PYEAR") <= F.lit(last) - w)


def _future_counts(events: DataFrame, focal: DataFrame, keys: list[str], w: int, kinds: dict[str, str]) -> DataFrame:
    """Rows and distinct triples of some categories on the same keys in the ``w`` years after each focal (keys, year).

    ``events(keys, PYEAR, edge_annotation, s, p, o)`` are counted per key,
    category, triple and year first; the join by key has at most that many
    rows for each focal year.
    """
    per = events.filter(F.col("edge_annotation").isin(*kinds)).groupBy(*keys, "edge_annotation", "s", "p", "o", F.col("PYEAR").alias("later")).agg(F.count("*").alias("n"))
    met = focal.select(*keys, "PYEAR").distinct().join(per, keys).filter((F.col("later") > F.col("PYEAR")) & (F.col("later") <= F.col("PYEAR") + w))
    once = met.groupBy(*keys, "PYEAR", "edge_annotation", "s", "p", "o").agg(F.sum("n").alias("n"))
    own = lambda k: F.col("edge_annotation") == k
    return once.groupBy(*keys, "PYEAR").agg(*[x for k, name in kinds.items() for x in (F.sum(F.when(own(k), F.col("n")).otherwise(0)).alias(f"{name}_rows"), F.count_if(own(k)).alias(f"{name}_triples"))])


def new_node_development(annotated: DataFrame, w: int = 5, last: int | None = None) -> DataFrame:
    """New_Node rows with what later rows touch any of their new endpoints.

    A later row that touches both new endpoints is on their pair, so the union
    is n(s) + n(o) - n(pair): no row is ever joined to a disjunction.
    """
    focal = _focal(annotated, w, last).filter(F.col("edge_annotation") == NEW[0])
    focal = focal.withColumns({"s_new": ~F.col("subject_seen_in_prior_window"), "o_new": ~F.col("object_seen_in_prior_window")})
    kinds = {NEW[1]: "nc", NEW[2]: "nr"}
    names = [f"{k}_{x}" for k in kinds.values() for x in ("rows", "triples")]
    ends = annotated.select(F.explode(F.array("s", "o")).alias("node"), "PYEAR", "edge_annotation", "s", "p", "o")
    new_ends = focal.select(F.explode(F.filter(F.array(F.when(F.col("s_new"), F.col("s")), F.when(F.col("o_new"), F.col("o"))), lambda x: x.isNotNull())).alias("node"), "PYEAR")
    by_node = _future_counts(ends, new_ends, ["node"], w, kinds)
    both = focal.filter(F.col("s_new") & F.col("o_new"))
    by_pair = _future_counts(annotated, both, ["node_a", "node_b"], w, kinds)
    side = lambda x: by_node.select(F.col("node").alias(x), "PYEAR", *[F.col(n).alias(f"{n}_{x}") for n in names])
    out = focal.join(side("s"), ["s", "PYEAR"], "left").join(side("o"), ["o", "PYEAR"], "left").join(by_pair, ["node_a", "node_b", "PYEAR"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    count = lambda n: F.when(F.col("s_new"), zero(f"{n}_s")).otherwise(0) + F.when(F.col("o_new"), zero(f"{n}_o")).otherwise(0) - F.when(F.col("s_new") & F.col("o_new"), zero(n)).otherwise(0)
    long = {"nc": "future_focal_new_node_new_combination", "nr": "future_focal_new_node_new_relation"}
    counted = {f"n_{long[k]}_{x}": count(f"{k}_{x}") for k in long for x in ("rows", "triples")}
    out = out.withColumns(counted)
    return out.select(
        *annotated.columns, F.col("s_new").alias("focal_subject_is_new_node"), F.col("o_new").alias("focal_object_is_new_node"),
        (F.col("s_new").cast("int") + F.col("o_new").cast("int")).alias("n_focal_new_nodes"), *counted, *[(F.col(f"n_{v}_rows") > 0).alias(f"{v}_seen") for v in long.values()],
    )


def new_combination_development(annotated: DataFrame, w: int = 5, last: int | None = None) -> DataFrame:
    """New_Combination rows with the later New_Relation rows and triples on their pair."""
    focal = _focal(annotated, w, last).filter(F.col("edge_annotation") == NEW[1])
    later = _future_counts(annotated, focal, ["node_a", "node_b"], w, {NEW[2]: "nr"})
    out = focal.join(later, ["node_a", "node_b", "PYEAR"], "left")
    rows, triples = F.coalesce("nr_rows", F.lit(0)), F.coalesce("nr_triples", F.lit(0))
    return out.select(*annotated.columns, (rows > 0).alias("future_focal_pair_new_relation_seen"), rows.alias("n_future_focal_pair_new_relation_rows"), triples.alias("n_future_focal_pair_new_relation_triples"))


def development_summary(developed: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """For each year: rows, rows developed, totals and maxima."""
    aggs = [F.count("*").alias("n_rows")]
    if "n_focal_new_nodes" in developed.columns:
        aggs += [F.count_if(F.col("n_focal_new_nodes") == k).alias(f"n_rows_with_{k}_new_nodes") for k in (1, 2)]
    for p in prefixes:
        aggs += [F.count_if(F.col(f"n_{p}_rows") > 0).alias(f"n_rows_{p}_seen")]
        aggs += [f(f"n_{p}_{x}").alias(f"{n}_{p}_{x}") for x in ("rows", "triples") for n, f in (("total", F.sum), ("max", F.max))]
    out = developed.groupBy("PYEAR").agg(*aggs)
    return out.withColumns({f"share_rows_{p}_seen": share(F.col(f"n_rows_{p}_seen"), F.col("n_rows")) for p in prefixes})


NODE_PREFIXES = ("future_focal_new_node_new_combination", "future_focal_new_node_new_relation")
PAIR_PREFIXES = ("future_focal_pair_new_relation",)


def paper_development_metrics(transitions: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """44 columns for each paper: what became of its new concepts and pairs."""
    nn = nodes.select(*KEY, F.col(f"{NODE_PREFIXES[0]}_seen").alias("nn_nc"), F.col(f"{NODE_PREFIXES[1]}_seen").alias("nn_nr"))
    nc = pairs.select(*KEY, F.col(f"{PAIR_PREFIXES[0]}_seen").alias("nc_nr"))
    no = lambda c: F.coalesce(c, F.lit(False))
    src = transitions.join(nn, list(KEY), "left").join(nc, list(KEY), "left")
    src = src.withColumns({c: no(c) for c in ("nn_nc", "nn_nr", "nc_nr")})
    is_nn, is_nc = F.col("edge_annotation") == NEW[0], F.col("edge_annotation") == NEW[1]
    a, x, y, z = (F.col(c) for c in ("future_exact_triple_seen", "nn_nc", "nn_nr", "nc_nr"))
    cases = {
        "n_new_node": is_nn, "n_new_combination": is_nc, "n_nn_future_nc": is_nn & x, "n_nn_future_nr": is_nn & y, "n_nn_future_any": is_nn & (x | y), "n_nc_future_nr": is_nc & z,
        "n_nn_dev_neither": is_nn & ~x & ~y, "n_nn_dev_nc_only": is_nn & x & ~y, "n_nn_dev_nr_only": is_nn & ~x & y, "n_nn_dev_both": is_nn & x & y,
    }
    for k, own, dev in (("nn", is_nn, x | y), ("nc", is_nc, z)):
        cases |= {f"n_{k}_neither_adopted_nor_developed": own & ~a & ~dev, f"n_{k}_adopted_only": own & a & ~dev, f"n_{k}_developed_only": own & ~a & dev, f"n_{k}_adopted_and_developed": own & a & dev}
    out = src.groupBy("PMID", "PYEAR").agg(*[F.count_if(v).alias(k) for k, v in cases.items()])
    unique = src.filter(is_nc).groupBy("PMID", "PYEAR", "node_a", "node_b").agg(F.max("nc_nr").alias("z")).groupBy("PMID", "PYEAR").agg(F.count("*").alias("n_unique_new_combination_pairs"), F.count_if("z").alias(f"n_{PAIR}"))
    out = out.join(unique, ["PMID", "PYEAR"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_unique_new_combination_pairs", f"n_{PAIR}")})
    of = lambda n: "n_unique_new_combination_pairs" if n == PAIR else "n_new_node" if n.startswith("nn_") else "n_new_combination"
    out = out.withColumns({f"share_{n}": share(F.col(f"n_{n}"), F.col(of(n))) for n in (*PATHS, *DEVELOPED, *JOINT, PAIR)})
    return out.withColumns({f"has_{n}": (F.col(f"n_{n}") > 0).cast("int") for n in (*PATHS, PAIR)})


def development_metrics_summary(metrics: DataFrame) -> DataFrame:
    sums = [c for c in metrics.columns if c.startswith("n_")]
    return metrics.groupBy("PYEAR").agg(
        F.count("*").alias("n_pmids"), F.count_if(F.col("n_new_node") > 0).alias("n_pmids_with_new_node"), F.count_if(F.col("n_new_combination") > 0).alias("n_pmids_with_new_combination"),
        *[F.count_if(F.col(f"has_{n}") == 1).alias(f"n_pmids_has_{n}") for n in (*PATHS, PAIR)], *[F.sum(c).alias(c) for c in sums],
    )


def endpoint_or_join(annotated: DataFrame, w: int = 5, last: int | None = None) -> DataFrame:
    """For each focal New_Node row, how many later rows touch any of its new endpoints, by an equi-join on endpoints."""
    focal = _focal(annotated, w, last).filter(F.col("edge_annotation") == NEW[0])
    ends = F.array(F.when(~F.col("subject_seen_in_prior_window"), F.col("s")), F.when(~F.col("object_seen_in_prior_window"), F.col("o")))
    left = focal.select(*KEY, F.explode(F.array_compact(ends)).alias("node"))
    right = annotated.select(F.explode(F.array("s", "o")).alias("node"), F.col("PYEAR").alias("later"), *[F.col(c).alias(f"r_{c}") for c in ("PMID", "s", "p", "o")])
    met = left.join(right, "node").filter((F.col("later") > F.col("PYEAR")) & (F.col("later") <= F.col("PYEAR") + w)).drop("node").distinct()
    return met.groupBy(*KEY).agg(F.count("*").alias("n_touching_rows"))
