"""Exact quantiles, bitmaps, sets of countries, fingerprints, stored vectors, repeated ids, code generation."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.functions import bitmaps, quantiles
from tripleloom.operators import citations, country, quality, vectors


def test_quantiles_of_groups_against_numpy(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, float("nan"), *[rnd.randrange(20) / 7 for _ in range(5)]]), float(rnd.randrange(1000))) for k in ("a", "b", None) for _ in range(200)] + [("empty", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for size in (7, 10_000):  # many ranges, one range
        got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], ["x", "y"], shares, size).collect()}
        for k in ("a", "b", None):
            for c, i in (("x", 1), ("y", 2)):
                values = [r[i] for r in rows if r[0] == k and r[i] is not None and r[i] == r[i]]
                assert got[k][f"{c}_q"] == pytest.approx(np.percentile(values, [100 * q for q in shares]).tolist())
        assert got["empty"]["x_q"] is None and got["empty"]["y_q"] == [1.0] * 6
    assert quantiles.exact_quantiles(df.limit(0), ["k"], ["x"], shares).count() == 0


def test_bitmaps_against_sets(spark):
    rnd = random.Random(8)
    rows = [(2000 + rnd.randrange(6), rnd.randrange(40)) for _ in range(150)] + [(None, 1), (2001, None)]
    bits = bitmaps.yearly_bitmaps(spark.createDataFrame(rows, "y int, k int"), ["k"], "y")
    of = {y: {k for z, k in rows if z == y and k is not None} for y in range(1990, 2006)}
    got = {(r.y, r.w): (r["size"], r.before, r.overlap) for r in bitmaps.prior_sets(bits, (1, 3)).collect()}
    for y in range(2000, 2006):
        for w in (1, 3):
            before = set().union(*[of[y - d] for d in range(1, w + 1)])
            assert got[y, w] == (len(of[y]), len(before), len(of[y] & before))


def test_more_countries_than_bits_of_a_word(spark):
    codes = [f"c{k:03}" for k in range(130)]
    tri = "PMID string, PYEAR int, s string, p string, o string, node_a string, node_b string, edge_annotation string"
    focal = [(f"f{k}", 2000, "A", "P", "B", "A", "B", ("New_Node", "New_Relation")[k % 2]) for k in range(130)]
    later = [("u", 2001, "A", "P", "B", "A", "B", "Repeated_Triple"), ("v", 2001, "B", "Q", "A", "A", "B", "Repeated_Triple"), ("w", 2009, "A", "P", "B", "A", "B", "Repeated_Triple")]
    transitions = spark.createDataFrame(focal, tri).withColumn("future_five_year_transition", F.lit("Adopted"))
    home = spark.createDataFrame([(f"f{k}", c, c) for k, c in enumerate(codes)] + [("u", "x", "X"), ("v", "x", "X"), ("v", "z", "Z"), ("w", "x", "X")], "pmid string, code string, name string")
    got = {(r.edge_annotation, r.adopter_country_code, r.source_country_code): (r.n_future_rows, r.n_future_pmids) for r in country.country_network_by_key(transitions, spark.createDataFrame(focal + later, tri), home, 5).collect()}
    assert {k for k in got if k[0] == "New_Relation"} == {("New_Relation", "x", c) for c in codes[1::2]}  # only u has the triple
    assert got["New_Node", "x", codes[128]] == (2, 2) and got["New_Node", "z", codes[0]] == (1, 1)
    assert got["Pooled_New_Knowledge", "x", codes[129]] == (1, 1) and got["Pooled_New_Knowledge", "x", codes[64]] == (2, 2)
    assert country.country_network_by_key(transitions, spark.createDataFrame(later, tri), home.limit(0), 5).count() == 0


def test_only_buckets_that_differ_are_compared(spark):
    a = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    assert quality.differing(a, a.repartition(5), a.columns) is None
    b = a.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v"))).union(a.filter("id = 7"))
    x, y = quality.differing(a, b, a.columns)
    assert x.count() < 10 and y.count() < 10
    got = {r.rule: r.n_violations for r in quality.bag_equality_report(a, b, "t").collect()}
    assert got == {"t: only left": 1, "t: only right": 2}
    assert {r.n_violations for r in quality.bag_equality_report(a, a.select(F.col("id").cast("int"), "v"), "t").collect()} == {0}
    report = {r.rule: r.n_violations for r in quality.recompute_report(a, b.filter("id <> 9").distinct(), "id").collect()}
    assert report["only stored"] == 1 and report["v differs"] == 1


def test_texts_are_encoded_once(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    texts = spark.createDataFrame([("one",), ("two",), ("two",), (None,)], "text string")
    assert vectors.add_texts(texts, store, "t", vectors.trigram_encoder, 32) == 2
    assert vectors.add_texts(texts.union(spark.createDataFrame([("three",)], "text string")), store, "t", vectors.trigram_encoder, 32, 2) == 1
    assert sorted((r.text, r.run, sum(r.vector)) for r in vectors.vectors(spark, store, "t").collect()) == [("one", 1, 5.0), ("three", 2, 7.0), ("two", 1, 5.0)]
    with pytest.raises(ValueError, match="encoder t is"):
        vectors.add_texts(texts, store, "t", vectors.trigram_encoder, 16)
    assert vectors.encoders(spark, store) == {"t": {"dimensions": 32}}


def test_repeated_works_are_an_error(spark):
    ours = spark.createDataFrame([("W1", 2000, 1, 2, 3), (None, 2000, 0, 0, 0), (None, 2000, 0, 0, 0)], "work_id string, publication_year int, citation_C3 long, citation_C5 long, citation_C10 long")
    other = spark.createDataFrame([("W1", 2000, 1, 2, 9)], "work_id string, other_year int, other_C3 int, other_C5 int, other_C10 int")
    assert citations.citation_match(ours, other).first().difference_C10 == -6
    with pytest.raises(Exception, match="several rows in the other source of work W1"):
        citations.citation_match(ours, other.union(other)).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", ["audit_papers", "audit3_rows", "linked_papers", "link_summary", "citation_windows", "prepare_triples"])
def test_code_is_generated(spark, name):
    """No generated method is too large for the JVM."""
    from tripleloom.plans import queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # with it, there is no code before the plan runs
    try:
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
        sizes = [plan.apply(i)._3().maxMethodCodeSize() for i in range(plan.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and min(sizes) >= 0 and max(sizes) < 1 << 16


@pytest.mark.parametrize("text,pmid", [("12", "12"), (" 0012 ", "12"), ("000", None), ("12.0", None), ("https://pubmed.ncbi.nlm.nih.gov/12/", "12"), ("http://www.ncbi.nlm.nih.gov/pubmed/012", "12"), ("https://pubmed.ncbi.nlm.nih.gov/12//", None), ("x/12", None), ("12\n", None), ("", None), (None, None)])
def test_identifiers(spark, text, pmid):
    from tripleloom.functions import ids

    row = spark.createDataFrame([(text,)], "t string").select(ids.pmid_strict(F.col("t")).alias("p")).first()
    assert row.p == pmid
