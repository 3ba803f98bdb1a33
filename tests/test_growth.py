"""Rows that are shuffled, of tables whose keys repeat much or little."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from tripleloom.operators import country


def shuffled(spark, run, what: str = "shuffleWriteRecords") -> int:
    """Rows (or ``what`` else) that ``run`` writes to shuffles."""
    sc = spark.sparkContext

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_papers_of_a_frequent_triple_do_not_become_countries(spark):
    tri = "PMID string, PYEAR int, s string, p string, o string, edge_annotation string"
    hot, rare = ("A", "P", "B"), ("A", "Q", "B")
    focal = [(f"f{k}", 2000, *hot, "Repeated_Triple") for k in range(400)] + [("f1", 2000, *rare, "New_Relation"), ("f7", 2001, *rare, "New_Relation")]
    later = [(f"u{k}", 2001 + k % 2, *hot, "Repeated_Triple") for k in range(400)] + [("u3", 2002, *rare, "Repeated_Triple"), ("u3", 2003, *hot, "Repeated_Triple"), ("u9", 2009, *hot, "Repeated_Triple")]
    home = [(f"{x}{k}", f"c{(k * (7 if x == 'u' else 3) + j) % 70:02}", f"Country {(k + j) % 9}" if j else " ") for x in "fu" for k in range(400) for j in range(1 + k % 2)] + [("f3", " ", "x"), ("f4", None, "x")]
    transitions = spark.createDataFrame(focal, tri).withColumn("future_five_year_transition", F.when(F.col("edge_annotation") == "New_Relation", "Adopted").otherwise("Continued"))
    annotated, places = spark.createDataFrame(focal + later, tri), spark.createDataFrame(home, "pmid string, code string, name string")
    codes = defaultdict(set)
    for pmid, code, _ in home:
        if code and code.strip():
            codes[pmid].add(code)
    seen = defaultdict(lambda: (set(), set(), set(), set()))
    for f in focal:
        for u in focal + later:
            if u[2:5] == f[2:5] and 0 < u[1] - f[1] <= 5:
                for a in codes[u[0]]:
                    for b in codes[f[0]]:
                        for kind in (f[5], *(("Pooled_New_Knowledge",) if f[5] == "New_Relation" else ())):
                            for found, x in zip(seen[f[1], kind, a, b], (f[2:5], (f[2:5], f[0], u[0]), f[0], u[0]), strict=True):
                                found.add(x)
    rows = []
    n = shuffled(spark, lambda: rows.extend(country.country_network(transitions, annotated, places, 5).collect()))
    got = {(r.focal_year, r.edge_annotation, r.adopter_country_code, r.source_country_code): (r.weight_unique_exact_triples, r.weight_source_pmid_x_future_pmid, r.weight_unique_source_pmids, r.weight_unique_future_pmids) for r in rows}
    assert got == {k: tuple(map(len, v)) for k, v in seen.items()} and len(got) > 1000
    assert n < 30_000
    summed = {(r.focal_year, r.edge_annotation): r.n_source_triple_country_rows for r in country.country_network_coverage(transitions, annotated, places, country.country_network(transitions, annotated, places, 5), 5).collect()}
    assert summed[2000, "Repeated_Triple"] == 70 and summed[2000, "New_Relation"] == summed[2000, "Pooled_New_Knowledge"] == 2 and summed[2001, "Repeated_Triple"] == 0
    assert country.country_network(transitions, annotated, places.limit(0), 5).count() == 0


def _keyed(spark, n: int):
    """Statements with long keys: every row is alone but for a few that repeat, differ in their raw concept, sentence or year, or are self loops."""
    long = lambda k: F.sha2(k.cast("string"), 256)
    k = F.col("id")
    alone = spark.range(n).select((k / 3).cast("long").cast("string").alias("PMID"), F.when(k % 5 > 0, "2001").otherwise("2002").alias("PYEAR"), F.lit("s").alias("SENTENCE_ID"), F.lit("P").alias("PREDICATE"), F.concat(F.lit("C"), long(k)).alias("subject_cui_primary"), F.concat(F.lit("C"), F.when(k % 4 == 0, long(k)).otherwise(long(-k))).alias("object_cui_primary"))
    alone = alone.withColumns({"SUBJECT_CUI": F.col("subject_cui_primary"), "OBJECT_CUI": F.col("object_cui_primary")})
    few = [("7", "2001", s, "P", "C1", "C2", a, "C2") for s, a in (("s", "C1"), ("s", "C1"), ("t", "C1|C3"))] + [("7", "2002", "s", "P", "C1", "C2", "C1", "C2"), ("8", "2001", "s", "P", "C5", "C5", "C5", "C5"), ("8", "2001", "s", "P", "C5", "C5", "C5|C6", "C5"), ("9", "2001", "s", "P", "C6", "C8", "C4", "C8"), ("9", "2001", "s", "P", "C7", "C8", "C4", "C8"), ("9", "2001", "s", None, "C7", "C8", "C4", "C8"), ("9", "2001", "s", None, "C7", "C8", "C4", "C8"), ("9", None, "s", "P", "C7", None, "C7", None), ("9", None, "s", "P", "C7", None, "C7", None)]
    return alone.union(spark.createDataFrame(few, ", ".join(f"{c} string" for c in alone.columns)))


def test_long_keys_are_grouped_by_numbers(spark):
    from collections import Counter

    from tripleloom.operators import profiles

    rows = _keyed(spark, 3000)
    local, want = rows.collect(), {}
    for year in ("2001", "2002", None):
        for scope in ("all", "non_self_loop"):
            for kind, (a, b, c) in {"raw": ("SUBJECT_CUI", "OBJECT_CUI", False), "primary": ("subject_cui_primary", "object_cui_primary", False), "primary_in_sentence": ("subject_cui_primary", "object_cui_primary", True)}.items():
                mine = [r for r in local if r.PYEAR == year and (scope == "all" or r.subject_cui_primary != r.object_cui_primary)]
                sizes = Counter((r.PMID, r[a], r.PREDICATE, r[b], c and r.SENTENCE_ID) for r in mine).values()
                want[year, scope, kind] = (len(mine), len(sizes), sum(n > 1 for n in sizes), sum(n for n in sizes if n > 1), sum(n - 1 for n in sizes), max(sizes))
    got = {}
    n = shuffled(spark, lambda: got.update({(r.PYEAR, r.scope, r.key_type): (r.n_rows, r.n_groups, r.n_duplicate_groups, r.n_rows_in_duplicate_groups, r.n_excess_rows, r.max_group_size) for r in profiles.duplicate_scope_summary(rows).collect()}))
    assert got == want
    assert n < 8000  # scopes times kinds of keys are 16 500
    found = []
    n = shuffled(spark, lambda: found.extend(profiles.collisions(rows).collect()), "shuffleWriteBytes")
    assert {(r.PMID, r.subject_cui_primary): (r.n_raw_variants, r.n_rows) for r in found} == {("7", "C1"): (2, 4), ("8", "C5"): (2, 2)}
    assert n < 150_000  # the keys are 350 000 bytes


def test_values_of_distinct_triples(spark):
    from tripleloom.operators import profiles

    S, P, O = profiles.S, profiles.P, profiles.O  # noqa: E741
    columns = ("PYEAR", "PMID", S, P, O, "subject_name_primary", "object_name_primary")
    rows = [(str(2000 + k % 2), f"p{k % 300}", f"C{k % 500}", f"P{k % 500 % 3}", f"C{k % 500 * 7 % 501}", f"n{k % 4}", f"n{k % 6}") for k in range(2000)] + [("2000", "p", "C1", None, "C9", None, "n1"), ("2000", None, None, "P1", "C3", "n9", None), (None, "p", None, None, None, None, None)]
    df, got = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), {}
    n = shuffled(spark, lambda: got.update({r.PYEAR: r for r in profiles._wide(df, ["PYEAR"], profiles.PREDICATES, loops=True).collect()}))
    for year in ("2000", "2001", None):
        mine = [dict(zip(columns, r, strict=True)) for r in rows if r[0] == year]
        some = lambda *c: len({v for r in mine if None not in (v := tuple(r[x] for x in c))})  # noqa: B023, E731
        either = lambda a, b: len({r[x] for r in mine for x in (a, b)} - {None})  # noqa: B023, E731
        pairs = {(min(v), max(v)) for r in mine if (v := [x for x in (r[S], r[O]) if x is not None])}
        want = {"n_pmid_unique_triples": len(mine), "n_self_loop_triples": sum(r[S] == r[O] and r[S] is not None for r in mine), "n_unique_pmid": some("PMID"), "n_unique_predicate": some(P), "n_unique_subject_cui_primary": some(S), "n_unique_object_cui_primary": some(O), "n_unique_cui_primary": either(S, O), "n_unique_exact_triple": some(S, P, O), "n_unique_directed_pair": some(S, O), "n_unique_pair_connection": len(pairs), "n_unique_subject_name_primary": some("subject_name_primary"), "n_unique_object_name_primary": some("object_name_primary"), "n_unique_name_primary": either("subject_name_primary", "object_name_primary")}
        assert {k: got[year][k] for k in want} == want
    assert n < 9000  # 14 177 with all values of all rows


def test_authors_are_dealt_by_their_number(spark, monkeypatch):
    from tripleloom.sources import adapters

    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    assert adapters.authorships(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 12


def test_labels_need_names_only(spark):
    from tripleloom.operators import semantic

    rows = [("C1", "a", "C2", "x"), ("C1", "b", "C2", "x"), ("C3", "z", "C1", "b"), ("C4", " ", "C5", None), ("C6", None, "C6", "s"), ("C7", "n", "C7", "m")]
    named = spark.createDataFrame(rows, "subject_cui_primary string, subject_name_primary string, object_cui_primary string, object_name_primary string")
    assert {r.primary_cui: r.label for r in semantic.concept_labels(named).collect()} == {"C1": "b", "C2": "x", "C3": "z", "C4": "C4", "C6": "s", "C7": "m"}


def test_queries_shuffle_only_what_they_read(spark):
    from tripleloom.plans.queries import queries

    # bytes of sf0.001; before: 2 930 000, 2 197 000, 2 197 000, 1 898 000
    for name, limit in {"new_relation_proximity": 2_000_000, "sample_flow": 500_000, "paper_master": 2_050_000, "uniqueness_report": 1_300_000}.items():
        assert shuffled(spark, lambda: queries()[name](spark, "/root/testdata/sf0.001").collect(), "shuffleWriteBytes") < limit, name  # noqa: B023


def test_numbers_of_values_go_on_alone(spark):
    from tripleloom.operators import profiles

    columns = ("PMID", "PYEAR", "PREDICATE", "subject_cui_primary", "object_cui_primary", "subject_name_primary", "object_name_primary", "SUBJECT_SEMTYPE", "OBJECT_SEMTYPE")
    rows = spark.createDataFrame([(f"p{k}", "2001" if k % 2 else "02001", f"P{k % 3}", "C1", f"C{k + 2}", "one", None, "t", " ") for k in range(2000)], ", ".join(f"{c} string" for c in columns))
    got = {r.primary_cui: r for r in profiles.concept_profile(rows).collect()}
    one = got["C1"]
    assert (one.n_unique_pmid, one.n_unique_pyear, one.n_active_pyear, one.n_unique_predicate, one.n_unique_neighbor_cui, one.n_unique_in_neighbor_cui, one.primary_name, one.all_primary_semtypes, one.n_distinct_primary_name) == (2000, 2, 1, 3, 2000, 0, "one", "t", 1)
    assert got["C2"].n_distinct_primary_semtype is None and got["C2"].all_primary_names is None
    plan = profiles.concept_profile(rows)._jdf.queryExecution().analyzed().toString().lower()
    assert "(distinct" not in plan and "filter(array" not in plan  # either made each of a concept's values meet again in a sort or cell by cell


def test_values_of_a_paper_meet_once(spark, monkeypatch):
    from tripleloom.operators import papers

    monkeypatch.setattr(papers, "TASK_ROWS", 300)
    kinds = papers.CATEGORIES
    tri = "PMID string, PYEAR int, s string, p string, o string, node_a string, node_b string, edge_annotation string, subject_seen_in_prior_window boolean, object_seen_in_prior_window boolean"

    def row(k):
        s, o, p = f"C{k % 7}", f"C{k % 11 + 7}", None if k % 5 == 0 else f"P{k % 3}"
        return (f"p{k % 400}", 2000 + k % 400 % 2, s, p, o, min(s, o), max(s, o), kinds[(k % 7 + k % 11 + k % 3) % 4], k % 7 > 2, k % 11 > 5)

    rows = [row(k) for k in range(3000)] + [row(k) for k in range(0, 3000, 4)] + [(None, *row(3)[1:])]
    df = spark.createDataFrame(rows, tri)
    for scope, of in ((["PMID", "PYEAR"], lambda r: r[:2]), (["PYEAR"], lambda r: r[1:2])):
        want: dict = defaultdict(lambda: (set(), set(), set()))
        for r in rows:
            if None not in of(r):
                found = want[of(r)]
                found[0].update({(r[2], not r[8]), (r[4], not r[9])})
                found[1].add((r[5], r[6], r[7] == kinds[1]))
                found[2].add((*r[2:5], r[7]))
        got: list = []
        n = shuffled(spark, lambda: got.extend(papers._new_knowledge(df, scope).collect()))  # noqa: B023
        out = {tuple(r[c] for c in scope): (r.n_unique_concepts, r.n_unique_new_concepts, r.n_unique_concept_pairs, r.n_unique_new_combination_pairs, r.n_triples, *(r[f"n_{k}"] for k in papers.KINDS), r.n_new_triples) for r in got}
        assert out == {k: (len(c), sum(new for _, new in c), len(p), sum(x[2] for x in p), len(t), *(sum(x[3] == kind for x in t) for kind in kinds), sum(x[3] != kinds[3] for x in t)) for k, (c, p, t) in want.items()}
        assert "PMID" not in scope or n < 5000  # a row for each statement; values of each kind met one another and then in a join
