"""Hand-made cases for annotation, adoption, networks and metrics, with a window of five years."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripleloom.functions import ids
from tripleloom.functions.windows import seen_after, seen_before, union_sizes
from tripleloom.operators import annotate, develop, network, papers, prepare, profiles, quality

SCHEMA = "PMID string, PYEAR int, s string, p string, o string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    """Years 1..8 with a window of two: focal 3..8 for annotation, 3..6 for transitions."""
    data = [
        ("1", 1, "A", "P", "B"), ("1", 1, "B", "P", "C"), ("2", 2, "A", "Q", "C"),
        ("3", 3, "A", "P", "B"),  # repeated
        ("3", 3, "A", "R", "B"),  # same pair, new relation
        ("3", 3, "B", "P", "A"),  # reversed with the same predicate: new relation
        ("4", 3, "A", None, "B"),  # no predicate
        ("4", 3, "X", "P", "A"),  # new node
        ("5", 4, "X", "P", "B"),  # new combination on the new node
        ("5", 4, "X", "P", "A"),  # adopted
        ("6", 5, "B", "S", "X"),  # new relation on the new pair
        ("6", 5, "C", "P", "C"), ("7", 6, None, "P", "C"), ("8", 8, "Z", "P", "Y"),
    ]
    return rows(spark, data).cache()


def test_labels_and_flags(small):
    got = {(r.PMID, r.s, r.p, r.o): r for r in annotate.edge_annotation(small, 2).collect()}
    label = {k: v.edge_annotation for k, v in got.items()}
    assert label[("3", "A", "P", "B")] == "Repeated_Triple"
    assert label[("3", "A", "R", "B")] == label[("3", "B", "P", "A")] == label[("4", "A", None, "B")] == "New_Relation"
    assert label[("4", "X", "P", "A")] == label[("8", "Z", "P", "Y")] == "New_Node"
    assert label[("5", "X", "P", "B")] == "New_Combination"
    assert label[("6", "B", "S", "X")] == "New_Relation"
    back = got[("3", "B", "P", "A")]
    assert back.reversed_edge_seen_in_prior_window and back.same_predicate_reversed_edge_seen_in_prior_window and not back.exact_edge_seen_in_prior_window
    assert got[("3", "A", "R", "B")].same_direction_different_predicate_seen_in_prior_window
    assert not got[("3", "A", "P", "B")].same_direction_different_predicate_seen_in_prior_window
    assert not any(s == o or s is None for _, s, _, o in got)
    assert quality.annotation_flag_report(annotate.edge_annotation(small, 2)).filter("n_violations > 0").count() == 0


def test_transitions_and_paper_metrics(small):
    t = annotate.edge_transition(small, 2)
    state = {(r.PMID, r.s, r.p, r.o): r.edge_annotation_to_future_transition for r in t.collect()}
    assert state[("4", "X", "P", "A")] == "New_Node -> Adopted"
    assert state[("3", "A", "P", "B")] == "Repeated_Triple -> Disappeared"
    m = {r.PMID: r for r in papers.paper_adoption_metrics(t).collect()}
    assert (m["4"].n_new_node_adopted, m["4"].share_new_node_adopted, m["4"].has_new_node_adopted) == (1, 1.0, 1)
    assert m["3"].share_new_node_adopted is None and m["3"].share_repeated_triple_continued == 0.0
    assert quality.metric_rule_report(papers.paper_adoption_metrics(t)).filter("n_violations > 0").count() == 0


def test_window_edges(spark):
    df = rows(spark, [("a", 1980, "A", "P", "B"), ("b", 1985, "A", "P", "B"), ("c", 1991, "A", "P", "B")])
    before = {r.PYEAR: r.seen for r in seen_before(df, ["s", "p", "o"], "PYEAR", 5).collect()}
    after = {r.PYEAR: r.seen for r in seen_after(df, ["s", "p", "o"], "PYEAR", 5).collect()}
    assert before == {1980: False, 1985: True, 1991: False}
    assert after == {1980: True, 1985: False, 1991: False}


@pytest.mark.parametrize("w", [1, 3])
def test_union_sizes(spark, w):
    data = [(k, y) for k, ys in {"a": (1, 2, 5), "b": (2,), "c": (4, 7)}.items() for y in ys]
    got = {r.y: r.n for r in union_sizes(spark.createDataFrame(data, "k string, y int"), ["k"], "y", w, "n").collect()}
    for y in range(1, 9):
        assert got.get(y, 0) == len({k for k, z in data if y - w <= z < y})


def test_network(spark):
    data = [("0", 1979, "Q", "P", "W"), ("1", 1980, "X", "P", "Y"), ("2", 1980, "X", "P", "Y"), ("1", 1980, "A", "R", "B"), ("5", 1985, "X", "P", "Y"), ("6", 1985, "X", "P", "Y"), ("7", 1986, "X", "P", "Y"), ("8", 1985, "Y", "P", "X")]
    ann = annotate.edge_annotation(rows(spark, data), 1)
    edges = {(r.adopter_pmid, r.focal_pmid): r.n_shared_new_triples for r in network.paper_network_edges(ann, 5).collect()}
    assert edges == {("5", "1"): 1, ("6", "1"): 1, ("5", "2"): 1, ("6", "2"): 1}
    profile = network.paper_network_profile(ann, 5).collect()
    assert sum(r.n_triple_paper_pair_occurrences for r in profile) == sum(edges.values())


def test_network_fan_out(spark):
    data = [("0", 1, "Q", "P", "W")] + [(f"f{i}", 2, "A", "P", "B") for i in range(60)] + [(f"g{i}", 3, "A", "P", "B") for i in range(100)]
    assert network.paper_network_edges(annotate.edge_annotation(rows(spark, data), 1), 1).count() == 6000


def test_development_identity(spark):
    import random

    rnd = random.Random(3)
    names = "ABCDEFGHIJ"
    data = list({(str(rnd.randrange(40)) + f"-{y}", y, rnd.choice(names), rnd.choice("PQ"), rnd.choice(names + "uvwxyz"[:y])) for y in range(1, 7) for _ in range(25)})
    ann = annotate.edge_annotation(rows(spark, data), 2).cache()
    got = {(r.PMID, r.s, r.p, r.o): r for r in develop.new_node_development(ann, 2).collect()}
    every = ann.collect()
    last = max(r.PYEAR for r in every)
    focal = [r for r in every if r.edge_annotation == "New_Node" and r.PYEAR <= last - 2]
    assert len(got) == len(focal) > 0
    for f in focal:
        new = {n for n, seen in ((f.s, f.subject_seen_in_prior_window), (f.o, f.object_seen_in_prior_window)) if not seen}
        for kind, name in (("New_Combination", "new_combination"), ("New_Relation", "new_relation")):
            hit = [g for g in every if g.edge_annotation == kind and f.PYEAR < g.PYEAR <= f.PYEAR + 2 and new & {g.s, g.o}]
            r = got[(f.PMID, f.s, f.p, f.o)]
            assert r[f"n_future_focal_new_node_{name}_rows"] == len(hit)
            assert r[f"n_future_focal_new_node_{name}_triples"] == len({(g.s, g.p, g.o) for g in hit})


def test_partitions_do_not_matter(spark, small):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, annotate.edge_transition(small, 2).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_empty_years_and_tables(spark):
    empty = rows(spark, [])
    assert annotate.edge_annotation(empty, 5).count() == 0
    assert annotate.edge_transition(empty, 5).count() == 0
    edges = network.paper_network_edges(annotate.edge_annotation(empty, 5), 5)
    years = spark.range(1980, 1983).select(F.col("id").cast("int").alias("focal_year"))
    assert [(r.focal_year, r.n_edges) for r in network.paper_network_summary(edges, years).orderBy("focal_year").collect()] == [(1980, 0), (1981, 0), (1982, 0)]


def test_identifiers(spark):
    values = ["0001", "000", "12.0", "https://pubmed.ncbi.nlm.nih.gov/77/", "http://www.ncbi.nlm.nih.gov/pubmed/9", "x7", " ", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(ids.pmid_strict(F.col("v")).alias("a"), ids.pmid_loose(F.col("v")).alias("b"))
    assert [r.a for r in df.collect()] == ["1", None, None, "77", "9", None, None, None]
    assert [r.b for r in df.collect()] == ["0001", "000", "12", "77", "9", "7", None, None]
    years = spark.createDataFrame([(v,) for v in ("2001", "2e3", "2001.8", " 1999 ", "3001", None)], "v string")
    assert [r.y for r in years.select(ids.year_strict(F.col("v")).alias("y")).collect()] == [2001, None, None, 1999, None, None]
    works = spark.createDataFrame([(v,) for v in ("W1/", "https://openalex.org/W22", "w3", "W", None)], "v string")
    assert [r.w for r in works.select(ids.work_strict(F.col("v")).alias("w")).collect()] == ["W1", "W22", None, None, None]
    codes = spark.createDataFrame([("NA", None, "x"), (" ", None, "Namibia"), (None, "de", "y"), (" ", None, "Elsewhere")], "c string, g string, n string")
    assert [r.k for r in codes.select(ids.country_code(F.col("c"), F.col("g"), F.col("n")).alias("k")).collect()] == ["NA", "NA", "DE", None]


def test_reports_name_each_corruption(spark):
    a = spark.createDataFrame([("1", 2), ("1", 2), ("2", 3)], "PMID string, n int")
    b = spark.createDataFrame([("1", 2), ("2", 4)], "PMID string, n int")
    report = lambda df: {r.rule: r.n_violations for r in df.collect()}
    assert report(quality.uniqueness_report({"a": (a, ["PMID"]), "b": (b, ["PMID"])})) == {"a": 1, "b": 0}
    assert report(quality.set_equality_report(a, b, "x")) == {"x: only left": 1, "x: only right": 1}
    assert report(quality.bag_equality_report(a, b, "x")) == {"x: only left": 2, "x: only right": 1}
    assert report(quality.recompute_report(b, a.distinct(), "PMID"))["n differs"] == 1


def test_readers(spark, tmp_path):
    from tripleloom.sources.files import CITATION_COLUMNS, null_marker, read_raw_csv, read_text_table

    (tmp_path / "raw.csv").write_bytes('"1","a \\"U\\" é","\\N","x","2001"\n'.encode("latin-1"))
    row = read_raw_csv(spark, str(tmp_path / "raw.csv"), CITATION_COLUMNS).first()
    assert (row.PMID, row.ISSN, row.DP, row.PYEAR) == ("1", 'a "U" é', None, "2001")
    (tmp_path / "t.csv").write_text('a,b\n"x ""y""",\n')
    assert tuple(read_text_table(spark, str(tmp_path / "t.csv"), ("a", "b")).first()) == ('x "y"', None)
    assert null_marker(spark.createDataFrame([("\\N", "v")], "a string, b string")).first() == (None, "v")


def test_tables_come_back_as_they_were_written(spark, tmp_path):
    from tripleloom.sources.files import read_snapshot, read_years, write_report, write_table

    df = spark.createDataFrame([(y, f"k{i}", i) for i, y in enumerate((1999, 2000, 2001, 2000, 2002))], "PYEAR int, k string, n long")
    write_table(df, str(tmp_path / "t"), order=["k"], partition=["PYEAR"], rows_per_file=1)
    assert sorted((r.PYEAR, r.k) for r in read_years(spark, str(tmp_path / "t"), 2000, 2001).collect()) == [(2000, "k1"), (2000, "k3"), (2001, "k2")]
    assert len(list((tmp_path / "t" / "PYEAR=2000").glob("*.zstd.parquet"))) == 2
    write_table(df.repartition(1), str(tmp_path / "one"), order=["n"])
    assert [r.n for r in spark.read.parquet(str(tmp_path / "one")).collect()] == [0, 1, 2, 3, 4]
    for form in ("csv", "json"):
        write_report(df, str(tmp_path / form), form)
        assert len(list((tmp_path / form).glob("part-*"))) == 1
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.json(str(tmp_path / "json")).count() == 5
    df.select("k", "n").write.json(str(tmp_path / "data" / "works" / "updated_date=2024-01-01"), compression="gzip")
    assert {(r.k, r.n) for r in read_snapshot(spark, str(tmp_path), "works", "k string, n long").collect()} == {(f"k{i}", i) for i in range(5)}


def test_intermediate_tables(spark):
    import os

    from tripleloom.sources.shared import written

    first = written(spark.range(3))
    second = written(first.selectExpr("id * 2 AS id"), first)
    assert sorted(r.id for r in second.collect()) == [0, 2, 4]
    assert not os.path.exists(first.written_at.removeprefix("file://")) and os.path.exists(second.written_at.removeprefix("file://"))


def test_frequent_triples_are_dealt_to_parts(spark, monkeypatch):
    data = [(f"f{i}", 2000, "A", "P", "B") for i in range(5)] + [(f"l{i}", 2001, "A", "P", "B") for i in range(40)] + [("z", 1999, "X", "P", "Y"), ("l0", 2001, "C", "P", "D"), ("f0", 2000, "C", "P", "D"), ("y", 2001, "X", "P", "Y")]
    ann = annotate.edge_annotation(rows(spark, data), 1)
    plain = sorted(map(tuple, network.paper_network_edges(ann, 1).collect()))
    monkeypatch.setattr(network, "LATER_ROWS", 7)
    monkeypatch.setattr(network, "MANY_TRIPLES", 0)
    assert len(plain) == 200 and sorted(map(tuple, network.paper_network_edges(ann, 1).collect())) == plain
    assert max(r[6 + 1] for r in plain) == 2  # two triples in one pair of papers


def test_shards_are_contiguous(spark):
    df = spark.createDataFrame([(k * 7 % 50, k % 3) for k in range(333)], "k long, v long")
    got = sorted(map(tuple, prepare.shard_manifest(df, "k", 100).collect()))
    ordered = sorted((k * 7 % 50) for k in range(333))
    assert got == [(s + 1, len(part), part[0], part[-1]) for s, part in enumerate(ordered[i : i + 100] for i in range(0, 333, 100))]
    assert prepare.shard_manifest(df.limit(0), "k", 100).count() == 0


def test_collisions_of_primary_keys(spark):
    data = [("1", "C1|X", "P", "C2", "C1", "C2"), ("1", "C1|Y", "P", "C2", "C1", "C2"), ("1", "C1|Y", "P", "C2", "C1", "C2"), ("2", "C1|X", "P", "C2", "C1", "C2"), ("2", "C1|X", "P", "C2", "C1", "C2")]
    df = spark.createDataFrame(data, "PMID string, SUBJECT_CUI string, PREDICATE string, OBJECT_CUI string, subject_cui_primary string, object_cui_primary string")
    assert tuple(profiles.collision_summary(df).first()) == (1, 2, 3, 2)
    assert [(r.PMID, r.n_raw_variants, r.n_rows) for r in profiles.collision_examples(df).collect()] == [("1", 2, 3)]


def test_country_lists_must_be_unique(spark):
    from tripleloom.operators import country

    papers = spark.createDataFrame([("1",), ("2",), ("1",)], "PMID string")
    once = spark.createDataFrame([("1", "A;B", "x;y", 2)], "pmid string, country_codes string, countries string, n_countries long")
    assert sorted(map(str, country.attach_country_lists(papers, once).collect())) == sorted(["Row(PMID='1', country_codes='A;B', countries='x;y', n_countries=2)"] * 2 + ["Row(PMID='2', country_codes=None, countries=None, n_countries=None)"])
    with pytest.raises(Exception, match="several country lists of paper 1"):
        country.attach_country_lists(papers, once.union(once)).collect()


def test_concept_profile_counts_a_self_loop_once(spark):
    cols = ["PMID", "PYEAR", "PREDICATE", "subject_cui_primary", "object_cui_primary", "subject_name_primary", "object_name_primary", "SUBJECT_SEMTYPE", "OBJECT_SEMTYPE"]
    df = spark.createDataFrame([("1", "2000", "P", "A", "A", "a", "b", "s", " "), ("1", "2001", "Q", "A", "B", "a", None, "t", "u"), ("2", "2001", "Q", "B", "A", None, "b", None, "s")], cols)
    r = {x.primary_cui: x for x in profiles.concept_profile(df).collect()}
    a = r["A"]
    assert (a.n_pmid_unique_triples, a.n_unique_pmid, a.n_subject_triples, a.n_object_triples, a.n_unique_neighbor_cui, a.n_unique_out_neighbor_cui) == (3, 2, 2, 2, 1, 1)
    assert (a.primary_name, a.all_primary_names, a.primary_semtype, a.first_seen_pyear, a.last_seen_pyear) == ("a", "a|b", "s", 2000, 2001)
    assert r["B"].primary_name is None and r["B"].all_primary_names is None and r["B"].primary_semtype == "u"
