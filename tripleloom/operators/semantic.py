"""Semantic proximity of concepts and relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import predicate_phrase, share
from ..functions.quantiles import with_quantiles
from ..functions.windows import union_sizes
from ..sources.shared import written
from .annotate import NEW, usable

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
DIMENSIONS = 32


def concept_text(profile: DataFrame) -> DataFrame:
    """Label of each concept: its modal name, else its id."""
    named = F.col("primary_name").isNotNull() & (F.trim("primary_name") != "")
    return profile.select(
        "primary_cui", F.when(named, F.col("primary_name")).otherwise(F.col("primary_cui")).alias("label"), F.when(named, "modal_name").otherwise("concept_id").alias("label_source"),
        "primary_name", "primary_semtype", "n_distinct_primary_name", "all_primary_names", "n_distinct_primary_semtype", "all_primary_semtypes", "n_pmid_unique_triples", "n_unique_pmid", "first_seen_pyear", "last_seen_pyear",
    )


def concept_text_summary(text: DataFrame) -> DataFrame:
    return text.groupBy("label_source").agg(F.count("*").alias("n_concepts"), F.count_distinct("label").alias("n_distinct_labels"), F.sum("n_pmid_unique_triples").alias("n_triples"))


def concept_labels(named: DataFrame) -> DataFrame:
    """``primary_cui, label`` as :func:`concept_text` has them, out of prepared triples with names only.

    A concept of which no row has a name is left out: it stands for itself anyway.
    """
    ends = F.array(*[F.struct(F.col(f"{x}_cui_primary").alias("c"), F.col(f"{x}_name_primary").alias("v")) for x in ("subject", "object")])
    counted = named.select(F.explode(ends).alias("e")).select("e.*").filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    modal = counted.groupBy("c").agg(F.min_by("v", F.struct((-F.col("n")).alias("m"), F.col("v").alias("v"))).alias("v"))
    return modal.select(F.col("c").alias("primary_cui"), F.when(F.trim("v") != "", F.col("v")).otherwise(F.col("c")).alias("label"))


def relation_text(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """Each distinct triple as a sentence; a concept without a label stands for itself."""
    out = triples.select("s", "p", "o").distinct()
    for side in ("s", "o"):
        out = out.join(labels.select(F.col("primary_cui").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    return out.select("s", "p", "o", F.concat_ws(" ", F.coalesce("label_s", "s"), predicate_phrase(F.col("p")), F.coalesce("label_o", "o")).alias("text"))


def sentence_vectors(triples: DataFrame, labels: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """``s, p, o, vector`` of the sentence of each distinct triple; an ``encoder`` gets each distinct sentence once."""
    text = relation_text(triples, labels)
    if encoder is None:
        return written(text.select("s", "p", "o", hashed_vector(F.col("text")).alias("vector")))
    text = written(text)
    return written(text.join(embed(text, encoder), "text").select("s", "p", "o", "vector"))


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of character trigrams of the padded text, in buckets by their md5."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.conv(F.substring(F.md5(F.substring(padded, i, F.lit(3))), 1, 7), 16, 10).cast("int") % dimensions)
    counts = lambda made: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(made, lambda g: g == d)).cast("double"))
    return F.get(F.transform(F.array(grams), counts), F.lit(0))  # bound once; inside of the lambda every bucket would make them anew


def embed(texts: DataFrame, encoder: Encoder | None = None, text_col: str = "text") -> DataFrame:
    """``text, vector`` of each distinct text.

    ``encoder`` maps frames with a column ``text`` to frames of text and vector,
    one Arrow batch after another; without one, hashed trigrams in plain SQL.
    """
    distinct = texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    if encoder is None:
        return distinct.withColumn("vector", hashed_vector(F.col("text")))
    return distinct.mapInPandas(encoder, "text string, vector array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null if a side is missing or all zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def embedding_norms(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors, least, mean and largest norm."""
    n = norm(F.col("vector"))
    return vectors.agg(F.count("*").alias("n_vectors"), F.round(F.min(n), 6).alias("min_norm"), F.round(F.avg(n), 6).alias("mean_norm"), F.round(F.max(n), 6).alias("max_norm"), F.count_if(n == 0).alias("n_zero_norm"))


def new_combination_proximity(annotated: DataFrame, vectors: DataFrame) -> DataFrame:
    """New_Combination rows with the cosine of their concepts' vectors (six decimals), each pair scored once."""
    rows = annotated.filter(F.col("edge_annotation") == NEW[1]).select("PMID", "PYEAR", "s", "p", "o", "node_a", "node_b")
    pairs = rows.select("node_a", "node_b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(vectors.select(F.col("concept").alias(f"node_{side}"), F.col("vector").alias(f"v_{side}")), f"node_{side}", "left")
    scored = pairs.select("node_a", "node_b", F.col("v_a").isNotNull().alias("has_vector_a"), F.col("v_b").isNotNull().alias("has_vector_b"), F.round(cosine(F.col("v_a"), F.col("v_b")), 6).alias("proximity"))
    return rows.join(scored, ["node_a", "node_b"])


def score_profile(rows: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles of a score."""
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count(score).alias("n_scored"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"),
    )
    names = [f"p{round(100 * q):02d}" for q in QUANTILES]
    return with_quantiles(out, rows, keys, [score], QUANTILES).withColumns({n: F.round(F.get(f"{score}_q", F.lit(i)), 6) for i, n in enumerate(names)}).drop(f"{score}_q")


def proximity_summary(scored: DataFrame) -> DataFrame:
    pairs = scored.groupBy("PYEAR").agg(F.count_distinct("node_a", "node_b").alias("n_pairs"), F.count_if(~F.col("has_vector_a") | ~F.col("has_vector_b")).alias("n_missing_vector"))
    return score_profile(scored, "proximity", ["PYEAR"]).join(pairs, "PYEAR")


def proximity_checks(summary: DataFrame) -> DataFrame:
    """Whether scores are in range, percentiles in order and all rows accounted for."""
    names = [f"p{round(100 * q):02d}" for q in QUANTILES]
    inside = (F.col("min") >= -1 - 1e-6) & (F.col("max") <= 1 + 1e-6)
    ordered = F.lit(True)
    for a, b in zip(["min", *names], [*names, "max"], strict=True):
        ordered = ordered & (F.col(a) <= F.col(b) + 1e-6)
    out = summary.select("PYEAR", F.coalesce(inside, F.lit(True)).alias("in_range"), F.coalesce(ordered, F.lit(True)).alias("quantiles_ordered"), (F.col("n_scored") + F.col("n_missing_vector") == F.col("n_rows")).alias("all_scored"))
    return out.withColumn("passed", F.col("in_range") & F.col("quantiles_ordered") & F.col("all_scored"))


def prior_relation_candidates(triples: DataFrame, annotated: DataFrame, w: int = 5) -> DataFrame:
    """For each distinct New_Relation triple and year, the other predicates of its directed pair in the ``w`` years before."""
    focal = annotated.filter(F.col("edge_annotation") == NEW[2]).select("PYEAR", "s", "p", "o").distinct()
    prior = usable(triples).filter("p is not null").select("s", "o", F.col("p").alias("prior_p"), F.col("PYEAR").alias("y")).distinct()
    met = focal.join(prior, ["s", "o"]).filter((F.col("y") >= F.col("PYEAR") - w) & (F.col("y") < F.col("PYEAR")) & (F.col("prior_p") != F.col("p")))
    return met.select("PYEAR", "s", "p", "o", "prior_p").distinct()


def new_relation_proximity(triples: DataFrame, annotated: DataFrame, labels: DataFrame, w: int = 5, encoder: Encoder | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """New_Relation rows with how close their triple is to what its pair had before, by sentence and by predicate.

    ``candidates`` are those of :func:`prior_relation_candidates` where they are already written.  A sentence
    has its vector once, and two predicates are compared once for all of their rows.
    """
    near = candidates if candidates is not None else written(prior_relation_candidates(triples, annotated, w))
    vectors = sentence_vectors(near.select("s", "p", "o").union(near.select("s", F.col("prior_p"), "o")), labels, encoder)
    of_pair = near.select("PYEAR", "s", "p", "o", "prior_p").join(vectors.withColumnRenamed("vector", "v"), ["s", "p", "o"]).join(vectors.withColumnsRenamed({"p": "prior_p", "vector": "pv"}), ["s", "prior_p", "o"]).select("PYEAR", "s", "p", "o", "prior_p", cosine(F.col("v"), F.col("pv")).alias("full"))
    phrases = written(near.select("p", "prior_p").distinct())
    both = phrases.select("p", "prior_p", predicate_phrase(F.col("p")).alias("t"), predicate_phrase(F.col("prior_p")).alias("pt"))
    words = embed(both.select(F.explode(F.array("t", "pt")).alias("text")), encoder)
    compared = both.join(words.withColumnsRenamed({"text": "t", "vector": "wv"}), "t").join(words.withColumnsRenamed({"text": "pt", "vector": "wpv"}), "pt").select("p", "prior_p", cosine(F.col("wv"), F.col("wpv")).alias("phrase"))
    scored = of_pair.join(written(compared), ["p", "prior_p"])
    best = lambda c: F.min_by("prior_p", F.struct((-F.round(c, 6)).alias("c"), F.col("prior_p").alias("p")))
    per = scored.groupBy("PYEAR", "s", "p", "o").agg(
        F.count("*").alias("n_prior_triples"), F.count_distinct("prior_p").alias("n_prior_predicates"),
        *[F.round(f(c), 6).alias(f"{n}_{c}_similarity") for c in ("full", "phrase") for n, f in (("max", F.max), ("mean", F.avg), ("min", F.min))],
        best("full").alias("closest_predicate_full"), best("phrase").alias("closest_predicate_phrase"),
    )
    rows = annotated.filter(F.col("edge_annotation") == NEW[2]).select("PMID", "PYEAR", "s", "p", "o")
    return rows.join(per, ["PYEAR", "s", "p", "o"], "left").withColumn("n_prior_triples", F.coalesce("n_prior_triples", F.lit(0)))


SCORES = {"full": "max_full_similarity", "phrase": "max_phrase_similarity"}


def new_relation_summary(scored: DataFrame, candidates: DataFrame, triples: DataFrame, annotated: DataFrame, w: int = 5) -> DataFrame:
    """For each year: rows, distinct triples, pairs, ends and predicates, what was compared, how far both scores reach, and their profiles.

    ``candidates`` are those of :func:`prior_relation_candidates`, ``scored`` the rows of :func:`new_relation_proximity`;
    of ``annotated`` only the years are read, so :func:`focal_rows` will do.
    """
    scored = written(scored)
    c = F.col
    per_triple = scored.groupBy("PYEAR", "s", "p", "o").agg(F.count("*").alias("n"), F.max("n_prior_triples").alias("prior"), F.max("n_prior_predicates").alias("predicates"), *[F.max(v).isNotNull().alias(f"has_{k}") for k, v in SCORES.items()])
    unique = per_triple.groupBy("PYEAR").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_unique_triples"), F.coalesce(F.sum(F.when(c("prior") > 0, c("n"))), F.lit(0)).alias("n_rows_with_prior"), F.round(F.avg(F.coalesce("predicates", F.lit(0))), 6).alias("mean_n_prior_predicates"), F.coalesce(F.max("predicates"), F.lit(0)).alias("max_n_prior_predicates"),
        *[x for k in SCORES for x in (F.coalesce(F.sum(F.when(c(f"has_{k}"), c("n"))), F.lit(0)).alias(f"n_scored_rows_{k}"), F.count_if(f"has_{k}").alias(f"n_scored_unique_triples_{k}"))],
    )
    # distinct values of several kinds, counted as rows of one distinct
    kind = lambda name, *v: F.struct(F.lit(name).alias("kind"), F.struct(*[x.alias(f"v{i}") for i, x in enumerate((*v, F.lit(None).cast("string"))[:2])]).alias("v"))
    kinds = {"n_unique_directed_pairs": (c("s"), c("o")), "n_unique_subject_cui": (c("s"),), "n_unique_object_cui": (c("o"),), "n_unique_focal_predicates": (c("p"),)}
    seen = per_triple.select("PYEAR", F.explode(F.array(*[kind(k, *v) for k, v in kinds.items()])).alias("x")).select("PYEAR", "x.*").distinct()
    ends = seen.groupBy("PYEAR").agg(*[F.count_if((c("kind") == k) & ~((c("kind") == "n_unique_focal_predicates") & c("v.v0").isNull())).alias(k) for k in kinds])
    compared = candidates.groupBy("PYEAR", "prior_p").agg(F.count("*").alias("n")).groupBy("PYEAR").agg(F.sum("n").alias("n_prior_comparison_triples"), F.count("prior_p").alias("n_unique_prior_predicates_in_comparisons"))
    before = union_sizes(usable(triples).filter("p is not null"), ["s", "p", "o"], "PYEAR", w, "n_prior_unique_triples_total")
    sizes = annotated.groupBy("PYEAR").agg(F.count("*").alias("n_edge_annotation_rows"))
    values = scored.groupBy("PYEAR").agg(*[x for k, v in SCORES.items() for x in (F.round(F.avg(v), 6).alias(f"mean_{k}"), F.round(F.stddev_pop(v), 6).alias(f"std_{k}"), F.min(v).alias(f"min_{k}"), F.max(v).alias(f"max_{k}"))])
    out = unique.join(ends, "PYEAR").join(values, "PYEAR").join(sizes, "PYEAR").join(compared, "PYEAR", "left").join(before, "PYEAR", "left")
    out = with_quantiles(out, scored, ["PYEAR"], [*SCORES.values()], QUANTILES)
    zero = ("n_prior_comparison_triples", "n_unique_prior_predicates_in_comparisons", "n_prior_unique_triples_total")
    names = {f"p{round(100 * q):02d}_{k}": F.round(F.get(f"{v}_q", F.lit(i)), 6) for k, v in SCORES.items() for i, q in enumerate(QUANTILES)}
    out = out.withColumns({z: F.coalesce(z, F.lit(0)) for z in zero} | names | {f"median_{k}": F.round(F.get(f"{v}_q", F.lit(QUANTILES.index(0.5))), 6) for k, v in SCORES.items()})
    shares = {"share_rows_with_prior": "n_rows_with_prior"} | {f"share_scored_rows_{k}": f"n_scored_rows_{k}" for k in SCORES}
    return out.withColumns({k: share(c(n), c("n_rows")) for k, n in shares.items()} | {"n_rows_without_prior": c("n_rows") - c("n_rows_with_prior")}).drop(*[f"{v}_q" for v in SCORES.values()])
