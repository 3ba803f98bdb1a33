"""Some queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
NAMES = ("edge_annotation", "edge_transition", "paper_adoption_metrics", "new_node_development", "country_network", "citation_windows", "prior_overlap", "spearman", "audit_papers", "pmid_country")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    from tripleloom.plans import oracle, queries

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    cur = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = queries.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([flat(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == sorted(repr([flat(r[names.index(c)]) for c in sorted(names)]) for r in want)


def test_every_query_has_a_twin():
    from tripleloom.plans import oracle, queries

    assert set(queries.queries()) == set(oracle.oracle_sql())
