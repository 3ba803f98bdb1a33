"""How new each statement is against the years before it, and whether it recurs in the years after.

A row has PMID, PYEAR (int), s, p, o.  Rows with a missing endpoint and self
loops are left out.  Labels are made for distinct triples and years: windows by
concept, by unordered pair, and by pair and predicate serve all years at once,
and a key's history has a few rows a year there, however frequent the key.
Other columns ride along with their rows in the last join only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import is_missing, share
from ..functions.windows import following, prior, seen_before, union_sizes, year_bounds

NEW = ("New_Node", "New_Combination", "New_Relation")
CATEGORIES = (*NEW, "Repeated_Triple")
FLAGS = ("subject_seen_in_prior_window", "object_seen_in_prior_window", "has_new_node", "pair_connected_in_prior_window", "exact_edge_seen_in_prior_window", "reversed_edge_seen_in_prior_window", "same_predicate_reversed_edge_seen_in_prior_window", "same_direction_different_predicate_seen_in_prior_window")


def usable(triples: DataFrame) -> DataFrame:
    """Rows with both endpoints that aren't self loops, with the pair ``a, b`` and the direction ``fwd``."""
    good = triples.filter(~is_missing(F.col("s")) & ~is_missing(F.col("o")) & (F.col("s") != F.col("o")) & F.col("PYEAR").isNotNull())
    return good.withColumns({"a": F.least("s", "o"), "b": F.greatest("s", "o"), "fwd": F.col("s") < F.col("o")})


def _labels(rows: DataFrame, w: int) -> DataFrame:
    """Of each distinct triple and year its flags, label and whether it recurs.

    They depend on nothing else, so papers don't take part.  After duplicates
    are gone a pair has a row for each year, predicate and direction at most;
    windows by pair and by pair and predicate share one shuffle.
    """
    once = rows.select("a", "b", "fwd", "s", "p", "o", "PYEAR").distinct()
    by_pair, year = prior(("a", "b"), "PYEAR", w), F.col("PYEAR")
    before, after = prior(("a", "b", "p"), "PYEAR", w), following(("a", "b", "p"), "PYEAR", w)
    on = lambda forward, c: F.when(F.col("fwd") == forward, c)
    over = {f"{n}_{k}": f(on(d, F.col("p"))).over(by_pair) for k, d in (("f", True), ("b", False)) for n, f in (("lo", F.min), ("hi", F.max))}
    over |= {f"y_{k}": F.max(on(d, year)).over(by_pair) for k, d in (("f", True), ("b", False))}
    known = F.col("p").isNotNull()
    over |= {f"{n}{k}": known & F.max(on(d, year)).over(spec).isNotNull() for n, spec in (("p", before), ("n", after)) for k, d in (("f", True), ("r", False))}
    out = once.withColumns(over)
    nodes = seen_before(once.select(F.explode(F.array("s", "o")).alias("node"), "PYEAR"), ["node"], "PYEAR", w)
    for side in ("s", "o"):
        out = out.join(nodes.select(F.col("node").alias(side), "PYEAR", F.col("seen").alias(f"seen_{side}")), [side, "PYEAR"])
    own = lambda f, r: F.when(F.col("fwd"), F.col(f)).otherwise(F.col(r))
    no = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "subject_seen_in_prior_window": F.col("seen_s"),
        "object_seen_in_prior_window": F.col("seen_o"),
        "has_new_node": ~(F.col("seen_s") & F.col("seen_o")),
        "pair_connected_in_prior_window": F.col("y_f").isNotNull() | F.col("y_b").isNotNull(),
        "exact_edge_seen_in_prior_window": own("pf", "pr"),
        "reversed_edge_seen_in_prior_window": own("y_b", "y_f").isNotNull(),
        "same_predicate_reversed_edge_seen_in_prior_window": own("pr", "pf"),
        "same_direction_different_predicate_seen_in_prior_window": no((own("lo_f", "lo_b") != F.col("p")) | (own("hi_f", "hi_b") != F.col("p"))),
    }
    out = out.withColumns(flags)
    kind = F.when(F.col("has_new_node"), NEW[0]).when(~F.col("pair_connected_in_prior_window"), NEW[1]).when(~F.col("exact_edge_seen_in_prior_window"), NEW[2]).otherwise(CATEGORIES[3])
    return out.select("s", "p", "o", "PYEAR", *FLAGS, kind.alias("edge_annotation"), own("nf", "nr").alias("future_exact_triple_seen"))


def annotated_rows(triples: DataFrame, w: int = 5) -> DataFrame:
    """All usable rows, of years without full windows too, with all their
    columns, ``a, b``, flags, ``edge_annotation`` and ``future_exact_triple_seen``.

    :func:`edge_annotation` and :func:`edge_transition` are views of it; write it once where both are used.
    """
    rows = usable(triples)
    labels = _labels(rows, w).select(*[F.col(c).alias(f"__{c}") for c in ("s", "p", "o", "PYEAR")], *FLAGS, "edge_annotation", "future_exact_triple_seen")
    same = (F.col("s") == F.col("__s")) & (F.col("o") == F.col("__o")) & (F.col("PYEAR") == F.col("__PYEAR")) & F.col("p").eqNullSafe(F.col("__p"))
    return rows.join(labels, same).drop("__s", "__p", "__o", "__PYEAR", "fwd")


Bounds = tuple[int | None, int | None]


def annotation_of(rows: DataFrame, w: int, bounds: Bounds) -> DataFrame:
    """:func:`edge_annotation` out of :func:`annotated_rows` and the first and last year."""
    first, last = bounds
    focal = rows.filter(F.col("PYEAR").between(F.lit(first) + w, F.lit(last)))
    return focal.select(*_own(rows), F.col("a").alias("node_a"), F.col("b").alias("node_b"), *FLAGS, "edge_annotation")


def _own(rows: DataFrame) -> list[str]:
    """The columns that came with the triples."""
    return [c for c in rows.columns if c not in ("a", "b", *FLAGS, "edge_annotation", "future_exact_triple_seen")]


def edge_annotation(triples: DataFrame, w: int = 5, bounds: Bounds | None = None) -> DataFrame:
    """The rows of focal years (all with a full window before them) with ``node_a, node_b``, eight flags and ``edge_annotation``."""
    return annotation_of(annotated_rows(triples, w), w, bounds or year_bounds(triples, "PYEAR"))


def edge_transition(triples: DataFrame, w: int = 5, bounds: Bounds | None = None) -> DataFrame:
    """Annotated rows of years with full windows on both sides, with what became of them."""
    return transition_of(annotated_rows(triples, w), w, bounds or year_bounds(triples, "PYEAR"))


def transition_of(rows: DataFrame, w: int, bounds: Bounds) -> DataFrame:
    """:func:`edge_transition` out of :func:`annotated_rows` and the first and last year."""
    first, last = bounds
    focal = rows.filter(F.col("PYEAR").between(F.lit(first) + w, F.lit(last) - w))
    seen = F.col("future_exact_triple_seen")
    state = F.when(~F.col("edge_annotation").isin(*CATEGORIES), "Not_Analyzed").when(~seen, "Disappeared").when(F.col("edge_annotation") == CATEGORIES[3], "Continued").otherwise("Adopted")
    out = focal.withColumn("future_five_year_transition", state).withColumn("edge_annotation_to_future_transition", F.concat_ws(" -> ", "edge_annotation", "future_five_year_transition"))
    return out.select(*_own(rows), F.col("a").alias("node_a"), F.col("b").alias("node_b"), *FLAGS, "edge_annotation", "future_exact_triple_seen", "future_five_year_transition", "edge_annotation_to_future_transition")


def focal_rows(triples: DataFrame, w: int, bounds: Bounds) -> DataFrame:
    """The rows that :func:`edge_annotation` has, without labels: each usable row has one, so no history is needed to count them."""
    first, last = bounds
    return usable(triples).filter(F.col("PYEAR").between(F.lit(first) + w, F.lit(last))).select(*triples.columns)


def same_pair_other_predicate(annotated: DataFrame) -> DataFrame:
    """Distinct triples and years whose directed pair had another predicate in the window before."""
    return annotated.filter("same_direction_different_predicate_seen_in_prior_window").select("PYEAR", "s", "p", "o").distinct()


def prior_nodes(triples: DataFrame, w: int = 5, bounds: Bounds | None = None) -> DataFrame:
    """For each focal year, how many concepts occur in the ``w`` years before."""
    first, last = bounds or year_bounds(triples, "PYEAR")
    return union_sizes(usable(triples).select(F.explode(F.array("s", "o")).alias("node"), "PYEAR"), ["node"], "PYEAR", w, "n_prior_nodes").filter(F.col("PYEAR").between(F.lit(first) + w, F.lit(last)))


def self_loop_summary(triples: DataFrame, w: int = 5, bounds: Bounds | None = None) -> DataFrame:
    first, last = bounds or year_bounds(triples, "PYEAR")
    bad = is_missing(F.col("s")) | is_missing(F.col("o"))
    counts = triples.filter(F.col("PYEAR").between(F.lit(first) + w, F.lit(last))).groupBy("PYEAR").agg(
        F.count("*").alias("n_focal_rows"), F.count_if(bad).alias("n_invalid_endpoint_rows"), F.count_if(~bad & (F.col("s") == F.col("o"))).alias("n_self_loop_rows"))
    out = counts.withColumn("n_non_self_loop_rows", F.col("n_focal_rows") - F.col("n_invalid_endpoint_rows") - F.col("n_self_loop_rows"))
    return out.withColumns({f"share_{x}_rows": share(F.col(f"n_{x}_rows"), F.col("n_focal_rows")) for x in ("invalid_endpoint", "self_loop")})


def annotation_summary(triples: DataFrame, w: int = 5, bounds: Bounds | None = None, annotated: DataFrame | None = None) -> DataFrame:
    """A row for each focal year: rows, sizes of the prior sets, counts and shares of the categories."""
    rows = usable(triples)
    first, last = bounds = bounds or year_bounds(triples, "PYEAR")
    annotated = edge_annotation(triples, w, bounds) if annotated is None else annotated
    sizes = [
        union_sizes(rows.select(F.explode(F.array("s", "o")).alias("node"), "PYEAR"), ["node"], "PYEAR", w, "n_prior_nodes"),
        union_sizes(rows, ["a", "b"], "PYEAR", w, "n_prior_pairs"),
        union_sizes(rows.filter("p is not null"), ["s", "p", "o"], "PYEAR", w, "n_prior_triples"),
    ]
    counts = annotated.groupBy("PYEAR").agg(F.count("*").alias("n_annotated_rows"), *[F.count_if(F.col("edge_annotation") == c).alias(f"n_{c}") for c in CATEGORIES])
    out = self_loop_summary(triples, w, bounds).drop("n_non_self_loop_rows").join(counts, "PYEAR", "left")
    for size in sizes:
        out = out.join(size, "PYEAR", "left")
    years = F.size(F.filter(F.sequence(F.col("PYEAR") - w, F.col("PYEAR") - 1), lambda y: y.between(first, last)))
    zero = [c for c in out.columns if c.startswith("n_")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("n_prior_years_found", years.cast("long"))
    return out.withColumns({f"share_{c}": share(F.col(f"n_{c}"), F.col("n_annotated_rows")) for c in CATEGORIES})


def annotation_checks(summary: DataFrame, w: int = 5) -> DataFrame:
    """Which of the summary's identities hold, a row for each year."""
    counts, shares = sum(F.col(f"n_{c}") for c in CATEGORIES), sum(F.coalesce(f"share_{c}", F.lit(0.0)) for c in CATEGORIES)
    rows = F.col("n_focal_rows") - F.col("n_invalid_endpoint_rows") - F.col("n_self_loop_rows")
    checks = {
        "category_sum_ok": counts == F.col("n_annotated_rows"),
        "share_sum_ok": (F.col("n_annotated_rows") == 0) | (F.abs(shares - 1) <= 1e-9),
        "row_accounting_ok": rows == F.col("n_annotated_rows"),
        "full_prior_window_ok": F.col("n_prior_years_found") == w,
    }
    out = summary.select("PYEAR", *[v.alias(k) for k, v in checks.items()])
    return out.withColumn("passed", F.col("category_sum_ok") & F.col("share_sum_ok") & F.col("row_accounting_ok") & F.col("full_prior_window_ok"))


def transition_summary(transitions: DataFrame) -> DataFrame:
    """A row for each year: counts and shares of states, and of category and state together."""
    states = ("Adopted", "Continued", "Disappeared")
    state, kind = F.col("future_five_year_transition"), F.col("edge_annotation")
    pairs = [(c, t) for c in CATEGORIES for t in (("Continued", "Disappeared") if c == CATEGORIES[3] else ("Adopted", "Disappeared"))]
    out = transitions.groupBy("PYEAR").agg(F.count("*").alias("n_rows"), *[F.count_if(state == t).alias(f"n_{t}") for t in states], *[F.count_if((kind == c) & (state == t)).alias(f"n_{c}_{t}") for c, t in pairs])
    return out.withColumns({f"share_{t}": share(F.col(f"n_{t}"), F.col("n_rows")) for t in states} | {f"share_{c}_{t}": share(F.col(f"n_{c}_{t}"), F.col("n_rows")) for c, t in pairs})
