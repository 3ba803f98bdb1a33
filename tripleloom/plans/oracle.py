"""SQL twins of the queries, for an engine that is not Spark.

They are written as the literal joins of the definitions (a focal year against
each year of its window), not as the windows that the queries use.
"""

from __future__ import annotations

import re

from ..operators.citations import WINDOWS
from ..operators.develop import DEVELOPED, JOINT, PATHS
from ..operators.papers import ADOPTION_FLAGS, ADOPTION_RATIOS, KINDS
from ..sources.adapters import SOURCE_FIELDS, W

CATS = ("New_Node", "New_Combination", "New_Relation", "Repeated_Triple")
NEW3 = "('New_Node', 'New_Combination', 'New_Relation')"
FLAGS = ("subject_seen", "object_seen", "pair_connected", "exact_edge_seen", "reversed_edge_seen", "same_predicate_reversed_edge_seen", "same_direction_different_predicate_seen")
LONG = "s AS subject_cui_primary, p AS PREDICATE, o AS object_cui_primary"


def _n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond})::BIGINT AS {name}"


def _share(n: str, d: str, name: str) -> str:
    return f"({n})::DOUBLE / nullif({d}, 0) AS {name}"


def _missing(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def _lead(text: str, hosts: tuple[str, ...]) -> str:
    """Whether what stands before the last ``/`` of a text is nothing or one of the addresses."""
    known = ", ".join(f"'{scheme}://{host}'" for scheme in ("http", "https") for host in hosts)
    return f"left({text}, length({text}) - length(string_split({text}, '/')[-1])) IN ('', {known})"


def _digits(text: str) -> str:
    return f"({text} <> '' AND translate({text}, '0123456789', '') = '')"


_BARE = "(CASE WHEN ends_with(trim(({0})::VARCHAR), '/') THEN left(trim(({0})::VARCHAR), -1) ELSE trim(({0})::VARCHAR) END)"
_LAST = f"string_split({_BARE}, '/')[-1]"
PMID = f"CASE WHEN {_lead(_BARE, ('www.ncbi.nlm.nih.gov/pubmed/', 'ncbi.nlm.nih.gov/pubmed/', 'pubmed.ncbi.nlm.nih.gov/'))} AND {_digits(_LAST)} THEN nullif(ltrim({_LAST}, '0'), '') END"
WORK = f"CASE WHEN {_lead(_BARE, ('openalex.org/',))} AND left({_LAST}, 1) = 'W' AND {_digits(f'substr({_LAST}, 2)')} THEN {_LAST} END"
YEAR = "CASE WHEN length(trim(({0})::VARCHAR)) = 4 AND translate(trim(({0})::VARCHAR), '0123456789', '') = '' AND left(trim(({0})::VARCHAR), 1) IN ('1', '2') THEN trim(({0})::VARCHAR)::INT END"
_PARTS = "string_split(lower(trim({0})), '/')"
DOI = f"nullif(CASE WHEN len({_PARTS}) > 3 AND {_PARTS}[1] IN ('http:', 'https:') AND {_PARTS}[2] = '' AND {_PARTS}[3] IN ('doi.org', 'dx.doi.org') THEN array_to_string({_PARTS}[4:], '/') ELSE lower(trim({{0}})) END, '')"
KEYS = "PMID, subject_cui_primary, PREDICATE, object_cui_primary"
PREPARED = "PREDICATION_ID, SENTENCE_ID, PMID, PYEAR, PREDICATE, SUBJECT_CUI, SUBJECT_NAME, SUBJECT_SEMTYPE, SUBJECT_NOVELTY, subject_cui_primary, subject_name_primary, OBJECT_CUI, OBJECT_NAME, OBJECT_SEMTYPE, OBJECT_NOVELTY, object_cui_primary, object_name_primary"
COUNTS = "count(*)::BIGINT AS n_triples, " + ", ".join(_n(f"edge_annotation = '{c}'", f"n_{k}") for c, k in zip(CATS, KINDS, strict=True)) + ", " + _n("edge_annotation <> 'Repeated_Triple'", "n_new_triples")
SHARES = ", ".join(_share(f"n_{k}", "n_triples", f"share_{k}") for k in (*KINDS, "new_triples"))
SELFS, SELFO = "subject_cui_primary", "object_cui_primary"
WIDE = (
    "count(*)::BIGINT AS n_pmid_unique_triples, count(DISTINCT PMID)::BIGINT AS n_unique_pmid, count(DISTINCT subject_cui_primary)::BIGINT AS n_unique_subject_cui_primary, count(DISTINCT object_cui_primary)::BIGINT AS n_unique_object_cui_primary, "
    "count(DISTINCT subject_name_primary)::BIGINT AS n_unique_subject_name_primary, count(DISTINCT object_name_primary)::BIGINT AS n_unique_object_name_primary, count(DISTINCT concat_ws(chr(31), subject_cui_primary, PREDICATE, object_cui_primary))::BIGINT AS n_unique_exact_triple, "
    "count(DISTINCT concat_ws(chr(31), subject_cui_primary, object_cui_primary))::BIGINT AS n_unique_directed_pair, count(DISTINCT concat_ws(chr(31), least(subject_cui_primary, object_cui_primary), greatest(subject_cui_primary, object_cui_primary)))::BIGINT AS n_unique_pair_connection"
)


def _prior(key: str, cols: str) -> str:
    """Distinct keys with the focal years in whose prior window they occur."""
    return f"SELECT DISTINCT {cols}, y.y FROM {key} k JOIN years y ON k.PYEAR BETWEEN y.y - {W} AND y.y - 1"


def _retention(by: str) -> str:
    names = ("n_pmid_unique_triples", "n_unique_pmid", "n_unique_predicate", "n_unique_exact_triple", "n_unique_pair_connection")
    side = lambda t: f"SELECT {by}, {WIDE}, count(DISTINCT PREDICATE)::BIGINT AS n_unique_predicate FROM {t} GROUP BY {by}"
    inner = ", ".join(f"coalesce(a.{n}, 0) AS {n}_raw, coalesce(b.{n}, 0) AS {n}_filtered" for n in names)
    return f"SELECT *, {', '.join(_share(f'{n}_filtered', f'{n}_raw', 'retention_' + n.removeprefix('n_')) for n in names)} FROM (SELECT {by}, {inner} FROM ({side('keyed')}) a FULL JOIN ({side('sample')}) b USING ({by}))"


def _overlap(key: str, cols: str, w: int) -> str:
    return f"SELECT f.y, count(*)::BIGINT AS o FROM (SELECT DISTINCT y, {cols} FROM {key}) f WHERE EXISTS (SELECT 1 FROM {key} p WHERE {' AND '.join(f'p.{c.strip()} = f.{c.strip()}' for c in cols.split(','))} AND p.y BETWEEN f.y - {w} AND f.y - 1) GROUP BY 1"


def _union(key: str, cols: str, w: int) -> str:
    return f"SELECT y.y, count(DISTINCT concat_ws(chr(31), {cols}))::BIGINT AS u FROM (SELECT DISTINCT y FROM node_y) y JOIN {key} p ON p.y BETWEEN y.y - {w} AND y.y - 1 GROUP BY 1"


def _size(key: str, cols: str) -> str:
    return f"SELECT y, count(DISTINCT concat_ws(chr(31), {cols}))::BIGINT AS f FROM {key} GROUP BY 1"


_WINDOWS = [("node_y", "k", "cui_primary", w) for w in (1, 3, 5)] + [("pair_y", "k1, k2", "pair_connection", 5), ("triple_y", "k1, k2, k3", "exact_triple", 5)]


def _prior_overlap() -> str:
    cols, joins = [], []
    for i, (key, c, name, w) in enumerate(_WINDOWS):
        joins.append(f"LEFT JOIN ({_overlap(key, c, w)}) o{i} USING (y) LEFT JOIN ({_union(key, c, w)}) u{i} USING (y) LEFT JOIN ({_size(key, c)}) f{i} USING (y)")
        short = name.removesuffix("_primary")
        cols += [f"coalesce(u{i}.u, 0) AS n_prior_{w}y_{name}", f"coalesce(o{i}.o, 0) AS n_overlap_prior_{w}y_{name}", f"coalesce(o{i}.o, 0)::DOUBLE / nullif(f{i}.f, 0) AS share_focal_{short}_seen_prior_{w}y"]
        if name == "cui_primary":
            cols += [f"f{i}.f - coalesce(o{i}.o, 0) AS n_new_cui_vs_prior_{w}y", f"(SELECT count(DISTINCT z.y) FROM node_y z WHERE z.y BETWEEN b.y - {w} AND b.y - 1) = {w} AS has_full_prior_{w}y_window"]
    return f"SELECT b.y AS PYEAR, {', '.join(cols)} FROM (SELECT DISTINCT y FROM node_y) b {' '.join(joins)}"


def _dev(kind: str, cat: str) -> str:
    """Later rows and triples of a category that touch a new end, by the literal disjunction."""
    return f"count(DISTINCT concat_ws(chr(31), g.PMID, g.s, g.p, g.o)) FILTER (WHERE g.edge_annotation = '{cat}')::BIGINT AS n_future_focal_new_node_{kind}_rows, count(DISTINCT concat_ws(chr(31), g.s, g.p, g.o)) FILTER (WHERE g.edge_annotation = '{cat}')::BIGINT AS n_future_focal_new_node_{kind}_triples"


def _dev_summary(table: str, prefixes: tuple[str, ...], nodes: bool) -> str:
    a = ["count(*)::BIGINT AS n_rows"]
    if nodes:
        a += [_n(f"n_focal_new_nodes = {k}", f"n_rows_with_{k}_new_nodes") for k in (1, 2)]
    for p in prefixes:
        a += [_n(f"n_{p}_rows > 0", f"n_rows_{p}_seen"), *[f"{f}(n_{p}_{x})::BIGINT AS {n}_{p}_{x}" for x in ("rows", "triples") for n, f in (("total", "sum"), ("max", "max"))]]
    return f"SELECT *, {', '.join(_share(f'n_rows_{p}_seen', 'n_rows', f'share_rows_{p}_seen') for p in prefixes)} FROM (SELECT PYEAR, {', '.join(a)} FROM {table} GROUP BY 1)"


_CASES = {
    "n_new_node": "nn", "n_new_combination": "nc", "n_nn_future_nc": "nn AND x", "n_nn_future_nr": "nn AND y", "n_nn_future_any": "nn AND (x OR y)", "n_nc_future_nr": "nc AND z", "n_nn_dev_neither": "nn AND NOT x AND NOT y", "n_nn_dev_nc_only": "nn AND x AND NOT y",
    "n_nn_dev_nr_only": "nn AND NOT x AND y", "n_nn_dev_both": "nn AND x AND y",
} | {f"n_{k}_{name}": f"{k} AND {cond.format(d)}" for k, d in (("nn", "(x OR y)"), ("nc", "z")) for name, cond in (("neither_adopted_nor_developed", "NOT a AND NOT {0}"), ("adopted_only", "a AND NOT {0}"), ("developed_only", "NOT a AND {0}"), ("adopted_and_developed", "a AND {0}"))}
_DEV_COUNTS = [*_CASES, "n_unique_new_combination_pairs", "n_nc_pairs_future_nr"]
_OF = lambda n: "n_unique_new_combination_pairs" if n == "nc_pairs_future_nr" else "n_new_node" if n.startswith("nn_") else "n_new_combination"
_EDGE = "focal_year, edge_annotation, future_five_year_transition, adopter_country_code, source_country_code"
_WEIGHTS = ("weight_unique_exact_triples", "weight_unique_source_pmids", "weight_unique_future_pmids", "weight_source_pmid_x_future_pmid")


def _norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda q: q::DOUBLE * q::DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / nullif({_norm(a)} * {_norm(b)}, 0)"


def _profile_sql(table: str, score: str, keys: str) -> str:
    qs = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    return f"SELECT {keys}, count(*)::BIGINT AS n_rows, count({score})::BIGINT AS n_scored, round(avg({score}), 6) AS mean, round(stddev_pop({score}), 6) AS std, min({score}) AS min, max({score}) AS max, {', '.join(f'round(quantile_cont({score}, {q}), 6) AS p{round(100 * q):02d}' for q in qs)} FROM {table} GROUP BY {keys}"


_GRAMS = "list_transform(range(1, length('  ' || lower({0}) || '  ') - 1), lambda i: ('0x' || substr(md5(substr('  ' || lower({0}) || '  ', i::INT, 3)), 1, 7))::BIGINT % 32)"


def _vector(text: str) -> str:
    return f"list_transform(range(0, 32), lambda d: len(list_filter({_GRAMS.format(text)}, lambda g: g = d))::DOUBLE)"


PHRASE = "regexp_replace(lower(trim(replace({0}, '_', ' '))), '\\s+', ' ', 'g')"

_FIELDS = ", ".join(f"{e} AS {c}" for c, e in SOURCE_FIELDS.items())

CTES: dict[str, str] = {
    "raw": "SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS PREDICATION_ID, concat_ws('.', l_orderkey, l_linenumber % 3) AS SENTENCE_ID, l_orderkey::VARCHAR AS PMID, l_returnflag || l_linestatus AS PREDICATE, "
    "(CASE WHEN l_linenumber = 1 THEN 'K' || o_custkey ELSE 'C' || (l_partkey % 200) END) || (CASE WHEN l_quantity > 40 THEN '|X' || (l_partkey % 7) ELSE '' END) AS SUBJECT_CUI, p_name || (CASE WHEN l_quantity > 45 THEN '|other' ELSE '' END) AS SUBJECT_NAME, p_type AS SUBJECT_SEMTYPE, "
    "CASE WHEN l_discount = 0 THEN '0' ELSE '1' END AS SUBJECT_NOVELTY, CASE WHEN l_linenumber = 2 OR (l_linenumber = 1 AND l_quantity > 25) THEN 'K' || ((o_custkey * 7 + l_suppkey) % 3000) ELSE 'C' || ((l_suppkey * 7 + l_linenumber * 13) % 100) END AS OBJECT_CUI, "
    "s_name AS OBJECT_NAME, p_brand AS OBJECT_SEMTYPE, CASE WHEN l_tax = 0 THEN '0' ELSE '1' END AS OBJECT_NOVELTY, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "cit": "SELECT o_orderkey::VARCHAR AS PMID, 'ISSN-' || (o_custkey % 50) AS ISSN, (year(o_orderdate) + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END) || ' Jan' AS DP, CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE year(o_orderdate) || '/01/02' END AS EDAT, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE year(o_orderdate)::VARCHAR END AS PYEAR FROM orders",
    "all_keyed": f"SELECT r.*, PYEAR, nullif(trim(split_part(SUBJECT_CUI, '|', 1)), '') AS subject_cui_primary, nullif(trim(split_part(SUBJECT_NAME, '|', 1)), '') AS subject_name_primary, nullif(trim(split_part(OBJECT_CUI, '|', 1)), '') AS object_cui_primary, nullif(trim(split_part(OBJECT_NAME, '|', 1)), '') AS object_name_primary, coalesce(try_cast(SUBJECT_NOVELTY AS DOUBLE) <> 0 AND try_cast(OBJECT_NOVELTY AS DOUBLE) <> 0, false) AS pass, {_missing('PMID')} OR PYEAR IS NULL OR {_missing('PREDICATE')} OR nullif(trim(split_part(SUBJECT_CUI, '|', 1)), '') IS NULL OR nullif(trim(split_part(OBJECT_CUI, '|', 1)), '') IS NULL AS mk FROM raw r LEFT JOIN (SELECT PMID, min(PYEAR) AS PYEAR FROM cit GROUP BY 1) USING (PMID)",
    "keyed": "SELECT * FROM all_keyed WHERE pass AND NOT mk",
    "prep": f"SELECT {PREPARED} FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM keyed) WHERE rn = 1",
    "sample": "SELECT * FROM prep WHERE PYEAR NOT IN ('1995') AND PREDICATE NOT IN ('NO')",
    "longc": "SELECT PMID, PYEAR, PREDICATE, subject_cui_primary AS s, object_cui_primary AS o, 'subject' AS role, subject_cui_primary AS concept, subject_name_primary AS name, nullif(trim(SUBJECT_SEMTYPE), '') AS semtype, object_cui_primary AS neighbour FROM prep UNION ALL SELECT PMID, PYEAR, PREDICATE, subject_cui_primary, object_cui_primary, 'object', object_cui_primary, object_name_primary, nullif(trim(OBJECT_SEMTYPE), ''), subject_cui_primary FROM prep",
    "node_y": "SELECT DISTINCT concept AS k, PYEAR::INT AS y FROM longc",
    "pair_y": "SELECT DISTINCT least(subject_cui_primary, object_cui_primary) AS k1, greatest(subject_cui_primary, object_cui_primary) AS k2, PYEAR::INT AS y FROM prep",
    "triple_y": "SELECT DISTINCT subject_cui_primary AS k1, PREDICATE AS k2, object_cui_primary AS k3, PYEAR::INT AS y FROM prep",
    "trip": "SELECT DISTINCT l_orderkey::VARCHAR AS PMID, year(o_orderdate)::INT AS PYEAR, CASE WHEN l_linenumber = 1 THEN 'K' || o_custkey ELSE 'C' || (l_partkey % 200) END AS s, l_returnflag || l_linestatus AS p, CASE WHEN l_linenumber = 2 OR (l_linenumber = 1 AND l_quantity > 25) THEN 'K' || ((o_custkey * 7 + l_suppkey) % 3000) ELSE 'C' || ((l_suppkey * 7 + l_linenumber * 13) % 100) END AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "ok": "SELECT *, least(s, o) AS a, greatest(s, o) AS b FROM trip WHERE s <> o",
    "years": f"SELECT y::INT AS y FROM range((SELECT min(PYEAR) FROM trip) + {W}, (SELECT max(PYEAR) FROM trip) + 1) r(y)",
    "nodes_k": "SELECT DISTINCT s AS n, PYEAR FROM ok UNION SELECT DISTINCT o, PYEAR FROM ok",
    "p_node": _prior("nodes_k", "n"),
    "p_pair": _prior("ok", "a, b"),
    "p_trip": _prior("ok", "s, p, o"),
    "p_dir": _prior("ok", "s, o"),
    "flagged": "SELECT f.PMID, f.PYEAR, f.s, f.p, f.o, f.a, f.b, x.n IS NOT NULL AS subject_seen, z.n IS NOT NULL AS object_seen, pp.a IS NOT NULL AS pair_connected, e.s IS NOT NULL AS exact_edge_seen, r.s IS NOT NULL AS reversed_edge_seen, q.s IS NOT NULL AS same_predicate_reversed_edge_seen, EXISTS (SELECT 1 FROM p_trip d WHERE d.s = f.s AND d.o = f.o AND d.p <> f.p AND d.y = f.PYEAR) AS same_direction_different_predicate_seen FROM ok f JOIN years ON f.PYEAR = years.y LEFT JOIN p_node x ON x.n = f.s AND x.y = f.PYEAR LEFT JOIN p_node z ON z.n = f.o AND z.y = f.PYEAR LEFT JOIN p_pair pp ON pp.a = f.a AND pp.b = f.b AND pp.y = f.PYEAR LEFT JOIN p_trip e ON e.s = f.s AND e.p = f.p AND e.o = f.o AND e.y = f.PYEAR LEFT JOIN p_dir r ON r.s = f.o AND r.o = f.s AND r.y = f.PYEAR LEFT JOIN p_trip q ON q.s = f.o AND q.p = f.p AND q.o = f.s AND q.y = f.PYEAR",
    "ann": "SELECT *, NOT (subject_seen AND object_seen) AS has_new_node, CASE WHEN NOT (subject_seen AND object_seen) THEN 'New_Node' WHEN NOT pair_connected THEN 'New_Combination' WHEN NOT exact_edge_seen THEN 'New_Relation' ELSE 'Repeated_Triple' END AS edge_annotation FROM flagged",
    "tr": f"SELECT *, CASE WHEN NOT seen THEN 'Disappeared' WHEN edge_annotation = 'Repeated_Triple' THEN 'Continued' ELSE 'Adopted' END AS state FROM (SELECT *, EXISTS (SELECT 1 FROM ok g WHERE g.s = ann.s AND g.p = ann.p AND g.o = ann.o AND g.PYEAR BETWEEN ann.PYEAR + 1 AND ann.PYEAR + {W}) AS seen FROM ann WHERE PYEAR <= (SELECT max(PYEAR) FROM trip) - {W})",
    "pam": f"SELECT *, {SHARES}, {', '.join(_share(f'n_{k}', 'n_new_triples', f'share_{k}_among_new') for k in KINDS[:3])} FROM (SELECT PMID, PYEAR, {COUNTS} FROM ann GROUP BY 1, 2)",
    "pat": "SELECT PMID, PYEAR, (n_new_node > 0)::INT AS has_new_node, (n_new_combination > 0)::INT AS has_new_combination, (n_new_relation > 0)::INT AS has_new_relation, (n_new_triples > 0)::INT AS has_new_triples, (n_new_node > 0)::INT + (n_new_combination > 0)::INT + (n_new_relation > 0)::INT AS n_new_knowledge_types, coalesce(nullif(concat_ws('+', CASE WHEN n_new_node > 0 THEN 'N' END, CASE WHEN n_new_combination > 0 THEN 'C' END, CASE WHEN n_new_relation > 0 THEN 'R' END), ''), 'Repeated_Only') AS knowledge_type_pattern, n_triples FROM pam",
    "pnk_c": "SELECT PMID, PYEAR, s AS c, NOT subject_seen AS new FROM ann UNION SELECT PMID, PYEAR, o, NOT object_seen FROM ann",
    "pnk": f"SELECT *, {_share('n_unique_new_concepts', 'n_unique_concepts', 'share_unique_new_concepts')}, {_share('n_unique_new_combination_pairs', 'n_unique_concept_pairs', 'share_unique_new_combination_pairs')}, {SHARES} FROM (SELECT PMID, PYEAR, count(*)::BIGINT AS n_unique_concepts, {_n('new', 'n_unique_new_concepts')} FROM pnk_c GROUP BY 1, 2) JOIN (SELECT PMID, PYEAR, count(*)::BIGINT AS n_unique_concept_pairs, {_n('new', 'n_unique_new_combination_pairs')} FROM (SELECT DISTINCT PMID, PYEAR, a, b, edge_annotation = 'New_Combination' AS new FROM ann) GROUP BY 1, 2) USING (PMID, PYEAR) JOIN (SELECT PMID, PYEAR, {COUNTS} FROM ann GROUP BY 1, 2) USING (PMID, PYEAR)",
    "ynk0": f"SELECT * FROM (SELECT PYEAR, count(*)::BIGINT AS n_unique_concepts, {_n('new', 'n_unique_new_concepts')} FROM (SELECT DISTINCT PYEAR, c, new FROM pnk_c) GROUP BY 1) JOIN (SELECT PYEAR, count(*)::BIGINT AS n_unique_concept_pairs, {_n('new', 'n_unique_new_combination_pairs')} FROM (SELECT DISTINCT PYEAR, a, b, edge_annotation = 'New_Combination' AS new FROM ann) GROUP BY 1) USING (PYEAR) JOIN (SELECT PYEAR, {COUNTS} FROM (SELECT DISTINCT PYEAR, s, p, o, edge_annotation FROM ann) GROUP BY 1) USING (PYEAR)",
    "ynk": "SELECT y::INT AS PYEAR, COLUMNS(c -> c LIKE 'n\\_%' ESCAPE '\\') FROM ynk0",
    "pad": f"SELECT *, {', '.join(_share(n, d, s) for s, n, d in ADOPTION_RATIOS)}, {', '.join(f'(n_{k} > 0)::INT AS has_{k}' for k in ADOPTION_FLAGS)} FROM (SELECT PMID, PYEAR, {COUNTS}, "
    + ", ".join(_n(f"edge_annotation = '{c}' AND state = 'Adopted'", f"n_{k}_adopted") for c, k in zip(CATS, KINDS[:3], strict=False))
    + f", {_n(chr(39).join(('state = ', 'Adopted', '')), 'n_new_triples_adopted')}, {_n(chr(39).join(('state = ', 'Continued', '')), 'n_repeated_triple_continued')}, {_n('seen', 'n_triples_reappeared')} FROM tr GROUP BY 1, 2)",
    "dec": f"SELECT PMID, PYEAR, n_triples, n_new_triples, n_new_triples_adopted, {_share('n_new_triples', 'n_triples', 'share_new_triples')}, share_new_triples_adopted, share_adopted_new_triples_in_all FROM pad",
    "focal_nn": f"SELECT * FROM ann WHERE edge_annotation = 'New_Node' AND PYEAR <= (SELECT max(PYEAR) FROM ann) - {W}",
    "nnd": f"SELECT f.*, NOT f.subject_seen AS sn, NOT f.object_seen AS onew, (NOT f.subject_seen)::INT + (NOT f.object_seen)::INT AS n_focal_new_nodes, d.* EXCLUDE (PMID, PYEAR, s, p, o) FROM focal_nn f JOIN (SELECT f.PMID, f.PYEAR, f.s, f.p, f.o, {_dev('new_combination', 'New_Combination')}, {_dev('new_relation', 'New_Relation')} FROM focal_nn f LEFT JOIN ann g ON g.PYEAR BETWEEN f.PYEAR + 1 AND f.PYEAR + {W} AND ((NOT f.subject_seen AND f.s IN (g.s, g.o)) OR (NOT f.object_seen AND f.o IN (g.s, g.o))) GROUP BY 1, 2, 3, 4, 5) d ON d.PMID = f.PMID AND d.s = f.s AND d.p IS NOT DISTINCT FROM f.p AND d.o = f.o",
    "focal_nc": f"SELECT * FROM ann WHERE edge_annotation = 'New_Combination' AND PYEAR <= (SELECT max(PYEAR) FROM ann) - {W}",
    "ncd": f"SELECT f.*, coalesce(r, 0)::BIGINT AS n_future_focal_pair_new_relation_rows, coalesce(t, 0)::BIGINT AS n_future_focal_pair_new_relation_triples FROM focal_nc f LEFT JOIN (SELECT f.PYEAR, f.a, f.b, count(DISTINCT concat_ws(chr(31), g.PMID, g.s, g.p, g.o)) AS r, count(DISTINCT concat_ws(chr(31), g.s, g.p, g.o)) AS t FROM (SELECT DISTINCT PYEAR, a, b FROM focal_nc) f JOIN ann g ON g.a = f.a AND g.b = f.b AND g.PYEAR BETWEEN f.PYEAR + 1 AND f.PYEAR + {W} AND g.edge_annotation = 'New_Relation' GROUP BY 1, 2, 3) USING (PYEAR, a, b)",
    "pdv": f"SELECT *, {', '.join(_share(f'n_{n}', _OF(n), f'share_{n}') for n in (*PATHS, *DEVELOPED, *JOINT, 'nc_pairs_future_nr'))}, {', '.join(f'(n_{n} > 0)::INT AS has_{n}' for n in (*PATHS, 'nc_pairs_future_nr'))} FROM (SELECT PMID, PYEAR, {', '.join(_n(v, k) for k, v in _CASES.items())}, count(DISTINCT CASE WHEN nc THEN a2 || chr(31) || b2 END)::BIGINT AS n_unique_new_combination_pairs, count(DISTINCT CASE WHEN nc AND z THEN a2 || chr(31) || b2 END)::BIGINT AS n_nc_pairs_future_nr FROM (SELECT t.PMID, t.PYEAR, t.a AS a2, t.b AS b2, t.seen AS a, t.edge_annotation = 'New_Node' AS nn, t.edge_annotation = 'New_Combination' AS nc, coalesce(n.n_future_focal_new_node_new_combination_rows > 0, false) AS x, coalesce(n.n_future_focal_new_node_new_relation_rows > 0, false) AS y, coalesce(c.n_future_focal_pair_new_relation_rows > 0, false) AS z FROM tr t LEFT JOIN nnd n ON n.PMID = t.PMID AND n.s = t.s AND n.p = t.p AND n.o = t.o LEFT JOIN ncd c ON c.PMID = t.PMID AND c.s = t.s AND c.p = t.p AND c.o = t.o) GROUP BY 1, 2)",
    "shared": f"SELECT f.PMID AS focal_pmid, f.PYEAR AS focal_year, u.PMID AS adopter_pmid, u.PYEAR AS adopter_year, f.edge_annotation, s, p, o FROM (SELECT * FROM ann WHERE edge_annotation IN {NEW3} AND PYEAR <= (SELECT max(PYEAR) FROM ann) - {W}) f JOIN ann u USING (s, p, o) WHERE u.PYEAR BETWEEN f.PYEAR + 1 AND f.PYEAR + {W}",
    "edg": f"SELECT adopter_pmid, focal_pmid, adopter_year, focal_year, {', '.join(_n(f'edge_annotation = {chr(39)}{c}{chr(39)}', f'n_shared_{k}_triples') for c, k in zip(CATS[:3], KINDS, strict=False))}, count(*)::BIGINT AS n_shared_new_triples, (adopter_year - focal_year)::INT AS year_gap FROM shared GROUP BY ALL",
    "nfo": f"SELECT PYEAR AS focal_year, s, p, o, count(DISTINCT PMID)::BIGINT AS n_focal_pmids FROM ann WHERE edge_annotation IN {NEW3} AND PYEAR <= (SELECT max(PYEAR) FROM ann) - {W} GROUP BY ALL",
    "nfu": "SELECT focal_year, s, p, o, count(DISTINCT adopter_pmid)::BIGINT AS n_future_pmids FROM shared GROUP BY ALL",
    "pc": "SELECT DISTINCT l_orderkey::VARCHAR AS pmid, 'N' || s_nationkey AS code, n_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "cnm": "SELECT code, min(name) AS name FROM pc GROUP BY 1",
    "cross": f"SELECT t.PYEAR AS focal_year, c.cat AS edge_annotation, t.state AS future_five_year_transition, h.code AS source_country_code, t.PMID AS source_pmid, t.s, t.p, t.o, k.code AS adopter_country_code, u.PMID AS future_pmid FROM tr t JOIN (SELECT edge_annotation AS e, edge_annotation AS cat FROM (SELECT DISTINCT edge_annotation FROM tr) UNION ALL SELECT e, 'Pooled_New_Knowledge' FROM (VALUES ('New_Node'), ('New_Combination'), ('New_Relation')) v(e)) c ON c.e = t.edge_annotation JOIN pc h ON h.pmid = t.PMID JOIN ann u ON u.s = t.s AND u.p = t.p AND u.o = t.o AND u.PYEAR BETWEEN t.PYEAR + 1 AND t.PYEAR + {W} JOIN pc k ON k.pmid = u.PMID WHERE t.state IN ('Adopted', 'Continued')",
    "cnet": f"SELECT c.*, a.name AS adopter_country, b.name AS source_country, adopter_country_code = source_country_code AS is_domestic_adoption FROM (SELECT {_EDGE}, count(DISTINCT concat_ws(chr(31), s, p, o))::BIGINT AS weight_unique_exact_triples, count(DISTINCT concat_ws(chr(31), s, p, o, source_pmid, future_pmid))::BIGINT AS weight_source_pmid_x_future_pmid, count(DISTINCT source_pmid)::BIGINT AS weight_unique_source_pmids, count(DISTINCT future_pmid)::BIGINT AS weight_unique_future_pmids FROM \"cross\" GROUP BY ALL) c LEFT JOIN cnm a ON a.code = adopter_country_code LEFT JOIN cnm b ON b.code = source_country_code",
    "par": f"SELECT PYEAR, edge_annotation, s, p, o, count(*)::BIGINT AS n_rows, count(DISTINCT PMID)::BIGINT AS n_pmids FROM ann WHERE edge_annotation IN {NEW3} GROUP BY ALL",
    "parp": f"SELECT PYEAR, edge_annotation, PMID FROM ann WHERE edge_annotation IN {NEW3}",
    "au": "SELECT DISTINCT 'W' || l_orderkey AS work_id, 'A' || l_suppkey AS author_id, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE 'I' || s_nationkey || '-' || (l_suppkey % 5) END AS institution_id, CASE WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber = 7 THEN 'last' ELSE 'middle' END AS author_position FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "inst": "SELECT 'I' || s_nationkey || '-' || (s_suppkey % 5) AS institution_id, 'Institute ' || s_nationkey || '-' || (s_suppkey % 5) AS display_name, CASE WHEN s_nationkey % 6 = 0 THEN ' ' WHEN s_nationkey % 5 = 0 THEN lower(substr(n_name, 1, 2)) ELSE substr(n_name, 1, 2) END AS country_code, CASE WHEN s_nationkey % 12 = 0 THEN NULL ELSE substr(n_name, 1, 2) END AS geo_code, CASE WHEN s_nationkey = 12 THEN 'Namibia' ELSE n_name END AS country_name, s_suppkey AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "icode": "SELECT *, CASE WHEN coalesce(nullif(trim(country_code), ''), nullif(trim(geo_code), '')) IS NULL AND lower(trim(country_name)) = 'namibia' THEN 'NA' ELSE upper(coalesce(nullif(trim(country_code), ''), nullif(trim(geo_code), ''))) END AS code FROM inst",
    "look": "SELECT institution_id, display_name, code AS country_code, country_name FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY code IS NULL, version DESC, display_name) AS rn FROM icode) WHERE rn = 1",
    "wid": "SELECT (CASE WHEN o_orderkey % 7 = 0 THEN 'https://openalex.org/' ELSE '' END) || 'W' || o_orderkey AS work_id, CASE WHEN o_orderkey % 13 = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || o_orderkey WHEN o_orderkey % 101 = 0 THEN 'none' ELSE o_orderkey::VARCHAR END AS pmid, 'https://doi.org/10.1/' || o_orderkey || 'A' AS doi FROM orders WHERE o_orderkey % 10 <> 9 UNION ALL SELECT 'W9' || o_orderkey || '00', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 34 = 0 THEN NULL ELSE '10.2/' || o_orderkey END FROM orders WHERE o_orderkey % 10 <> 9 AND o_orderkey % 17 = 0 UNION ALL SELECT 'W' || o_orderkey, (o_orderkey + 1)::VARCHAR, 'https://doi.org/10.1/' || o_orderkey || 'a' FROM orders WHERE o_orderkey % 10 <> 9 AND o_orderkey % 29 = 0",
    "wyr": "SELECT 'W' || o_orderkey AS work_id, CASE WHEN o_orderkey % 41 = 0 THEN '2e3' ELSE (year(o_orderdate) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END)::VARCHAR END AS publication_year FROM orders WHERE o_orderkey % 19 <> 0 UNION ALL SELECT 'W9' || o_orderkey || '00', year(o_orderdate)::VARCHAR FROM orders WHERE o_orderkey % 19 <> 0 AND o_orderkey % 17 = 0",
    "spap": f"SELECT 'W' || o_orderkey AS paperid, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE (year(o_orderdate) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END)::VARCHAR END AS year, o_custkey % 9 AS C3, o_custkey % 14 AS C5, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 30 END AS C10, o_custkey % 12 + 1 AS team_size, {_FIELDS} FROM orders WHERE o_orderkey % 19 <> 1",
    "awi": "SELECT pmid, au.work_id, author_id, author_position, institution_id, display_name, country_code, country_name FROM au JOIN (SELECT regexp_extract(work_id, '(W[0-9]+)', 1) AS work_id, min(nullif(regexp_extract(trim(pmid), '([0-9]+)$', 1), '')) AS pmid FROM wid WHERE nullif(regexp_extract(trim(pmid), '([0-9]+)$', 1), '') IS NOT NULL GROUP BY 1) USING (work_id) LEFT JOIN look USING (institution_id)",
    "pco": "SELECT pmid, country_code AS institution_country_code, string_agg(DISTINCT country_name, '; ' ORDER BY country_name) AS institution_country, 1::BIGINT AS pmid_country_weight, count(DISTINCT work_id)::BIGINT AS n_work_ids_for_pmid_country, count(DISTINCT author_id)::BIGINT AS n_authors_for_pmid_country, count(DISTINCT institution_id)::BIGINT AS n_institutions_for_pmid_country, count(*)::BIGINT AS n_authorship_institution_rows_for_pmid_country FROM awi WHERE trim(coalesce(country_code, '')) <> '' GROUP BY ALL",
    "pcl": "SELECT pmid, string_agg(DISTINCT institution_country_code, ';' ORDER BY institution_country_code) AS country_codes, string_agg(DISTINCT institution_country, ';' ORDER BY institution_country) AS countries, count(DISTINCT institution_country_code)::BIGINT AS n_countries FROM pco GROUP BY 1",
    "refs": "SELECT 'W' || l_orderkey AS work_id, 'W' || ((l_partkey * 7919 + l_suppkey * 31 + l_linenumber) % (SELECT count(*) FROM orders)) AS referenced_work_id FROM lineitem",
    "wy": f"SELECT work_id, min(year)::INT AS year FROM (SELECT {WORK.format('work_id')} AS work_id, {YEAR.format('publication_year')} AS year FROM wyr) WHERE work_id IS NOT NULL AND year IS NOT NULL GROUP BY 1",
    "edges_y": "SELECT r.*, a.year AS citing, b.year AS cited FROM refs r LEFT JOIN wy a ON a.work_id = r.work_id LEFT JOIN wy b ON b.work_id = r.referenced_work_id",
    "cw": "SELECT w.work_id, w.year AS publication_year, coalesce(n, 0)::BIGINT AS n_references, " + ", ".join(f"coalesce(c{k}, 0)::BIGINT AS citation_C{k}" for k in WINDOWS) + ", coalesce(ca, 0)::BIGINT AS citation_through_cutoff, " + ", ".join(f"w.year + {k} <= 2000 AS has_complete_C{k}_window" for k in WINDOWS) + " FROM wy w LEFT JOIN (SELECT work_id, count(*) AS n FROM edges_y WHERE citing <= 2000 GROUP BY 1) USING (work_id) LEFT JOIN (SELECT referenced_work_id AS work_id, " + ", ".join(f"count(*) FILTER (WHERE citing - cited BETWEEN 0 AND {k}) AS c{k}" for k in WINDOWS) + ", count(*) FILTER (WHERE citing >= cited) AS ca FROM edges_y WHERE citing <= 2000 AND cited IS NOT NULL GROUP BY 1) USING (work_id)",
    "oth": f"SELECT paperid AS work_id, {YEAR.format('year')} AS other_year, C3 AS other_C3, C5 AS other_C5, C10 AS other_C10 FROM spap",
    "cm": "SELECT work_id, publication_year, " + ", ".join(f"citation_C{k}, other_C{k}::BIGINT AS other_C{k}, citation_C{k} - other_C{k} AS difference_C{k}" for k in WINDOWS) + " FROM cw JOIN oth USING (work_id) WHERE publication_year = other_year AND work_id IN (SELECT work_id FROM oth GROUP BY 1 HAVING count(*) = 1)",
    "cml": " UNION ALL ".join(f"SELECT publication_year, 'C{k}' AS \"window\", citation_C{k}::DOUBLE AS x, other_C{k}::DOUBLE AS y FROM cm WHERE other_C{k} IS NOT NULL" for k in WINDOWS),
    "cpf": "SELECT concept AS primary_cui, count(DISTINCT concat_ws(chr(31), PMID, s, PREDICATE, o))::BIGINT AS n_pmid_unique_triples, count(DISTINCT PMID)::BIGINT AS n_unique_pmid, count(DISTINCT PYEAR)::BIGINT AS n_unique_pyear, min(PYEAR::INT) AS first_seen_pyear, max(PYEAR::INT) AS last_seen_pyear, max(PYEAR::INT) - min(PYEAR::INT) + 1 AS active_year_span, count(DISTINCT PYEAR)::BIGINT AS n_active_pyear, count(DISTINCT PREDICATE)::BIGINT AS n_unique_predicate, "
    + ", ".join(f"count(*) FILTER (WHERE role = '{r}')::BIGINT AS n_{r}_triples, (count(*) FILTER (WHERE role = '{r}'))::DOUBLE / count(*) AS share_as_{r}, count(DISTINCT PMID) FILTER (WHERE role = '{r}')::BIGINT AS n_unique_pmid_as_{r}, count(DISTINCT PREDICATE) FILTER (WHERE role = '{r}')::BIGINT AS n_unique_predicate_as_{r}, count(DISTINCT neighbour) FILTER (WHERE role = '{r}' AND neighbour <> concept)::BIGINT AS n_unique_{x}_neighbor_cui" for r, x in (("subject", "out"), ("object", "in")))
    + ", count(DISTINCT neighbour) FILTER (WHERE neighbour <> concept)::BIGINT AS n_unique_neighbor_cui, any_value(mn.name) AS primary_name, any_value(mn.n)::BIGINT AS n_distinct_primary_name, any_value(mn.l) AS all_primary_names, any_value(ms.semtype) AS primary_semtype, any_value(ms.n)::BIGINT AS n_distinct_primary_semtype, any_value(ms.l) AS all_primary_semtypes FROM longc "
    + " ".join(f"LEFT JOIN (SELECT concept, arg_min({v}, (-c, {v})) AS {v}, count(*) AS n, string_agg({v}, '|' ORDER BY {v}) AS l FROM (SELECT concept, {v}, count(*) AS c FROM longc WHERE {v} IS NOT NULL GROUP BY 1, 2) GROUP BY 1) {a} USING (concept)" for v, a in (("name", "mn"), ("semtype", "ms"))) + " GROUP BY 1",
    "lab": "SELECT primary_cui, CASE WHEN trim(coalesce(primary_name, '')) <> '' THEN primary_name ELSE primary_cui END AS label, CASE WHEN trim(coalesce(primary_name, '')) <> '' THEN 'modal_name' ELSE 'concept_id' END AS label_source, primary_name, primary_semtype, n_distinct_primary_name, all_primary_names, n_distinct_primary_semtype, all_primary_semtypes, n_pmid_unique_triples, n_unique_pmid, first_seen_pyear, last_seen_pyear FROM cpf",
    "vec": "SELECT 'C' || vec_id AS concept, embedding AS v FROM embeddings",
    "prox": f"SELECT PMID, PYEAR, {LONG}, a AS node_a, b AS node_b, x.v IS NOT NULL AS has_vector_a, z.v IS NOT NULL AS has_vector_b, round({_cos('x.v', 'z.v')}, 6) AS proximity FROM ann LEFT JOIN vec x ON x.concept = a LEFT JOIN vec z ON z.concept = b WHERE edge_annotation = 'New_Combination'",
    "proxs": f"SELECT * FROM ({_profile_sql('prox', 'proximity', 'PYEAR')}) JOIN (SELECT PYEAR, count(DISTINCT (node_a, node_b))::BIGINT AS n_pairs, {_n('NOT (has_vector_a AND has_vector_b)', 'n_missing_vector')} FROM prox GROUP BY 1) USING (PYEAR)",
    "prc": f"SELECT DISTINCT f.PYEAR, f.s, f.p, f.o, g.p AS prior_p FROM ann f JOIN ok g ON g.s = f.s AND g.o = f.o AND g.p <> f.p AND g.PYEAR BETWEEN f.PYEAR - {W} AND f.PYEAR - 1 WHERE f.edge_annotation = 'New_Relation'",
    "reltext": f"SELECT s, p, o, coalesce(x.label, s) || ' ' || {PHRASE.format('p')} || ' ' || coalesce(z.label, o) AS text FROM (SELECT DISTINCT s, p, o FROM trip) LEFT JOIN lab x ON x.primary_cui = s LEFT JOIN lab z ON z.primary_cui = o",
    "relvec": f"SELECT text, {_vector('text')} AS v FROM (SELECT DISTINCT text FROM reltext JOIN (SELECT s, p, o FROM prc UNION SELECT s, prior_p, o FROM prc) USING (s, p, o) UNION SELECT {PHRASE.format('p')} FROM (SELECT p FROM prc UNION SELECT prior_p FROM prc))",
    "relsim": f"SELECT c.PYEAR, c.s, c.p, c.o, c.prior_p, {_cos('fv.v', 'gv.v')} AS f, {_cos('pv.v', 'qv.v')} AS h FROM prc c JOIN reltext a ON a.s = c.s AND a.p = c.p AND a.o = c.o JOIN reltext b ON b.s = c.s AND b.p = c.prior_p AND b.o = c.o JOIN relvec fv ON fv.text = a.text JOIN relvec gv ON gv.text = b.text JOIN relvec pv ON pv.text = {PHRASE.format('c.p')} JOIN relvec qv ON qv.text = {PHRASE.format('c.prior_p')}",
    "relprox": "SELECT a.PMID, a.PYEAR, a.s, a.p, a.o, coalesce(n, 0)::BIGINT AS n_prior_triples, np::BIGINT AS n_prior_predicates, x.* EXCLUDE (PYEAR, s, p, o, n, np) FROM (SELECT * FROM ann WHERE edge_annotation = 'New_Relation') a LEFT JOIN (SELECT PYEAR, s, p, o, count(*) AS n, count(DISTINCT prior_p) AS np, round(max(f), 6) AS max_full_similarity, round(avg(f), 6) AS mean_full_similarity, round(min(f), 6) AS min_full_similarity, round(max(h), 6) AS max_phrase_similarity, round(avg(h), 6) AS mean_phrase_similarity, round(min(h), 6) AS min_phrase_similarity, arg_min(prior_p, (-round(f, 6), prior_p)) AS closest_predicate_full, arg_min(prior_p, (-round(h, 6), prior_p)) AS closest_predicate_phrase FROM relsim GROUP BY 1, 2, 3, 4) x ON x.PYEAR = a.PYEAR AND x.s = a.s AND x.p = a.p AND x.o = a.o",
    "cohort": f"SELECT DISTINCT {PMID.format('PMID')} AS PMID, PYEAR FROM trip",
    "maps": f"SELECT DISTINCT {PMID.format('pmid')} AS pmid, {WORK.format('work_id')} AS work_id FROM wid WHERE {PMID.format('pmid')} IS NOT NULL AND {WORK.format('work_id')} IS NOT NULL",
    "agy": f"SELECT pmid, count(*)::BIGINT AS semmed_rows, string_agg(DISTINCT ISSN, '; ' ORDER BY ISSN) AS journal_issns, count(DISTINCT y)::BIGINT AS n_semmed_years, {_n('y IS NULL', 'invalid_semmed_year_rows')}, " + ", ".join(f"CASE WHEN count(DISTINCT {c}) = 1 AND count(*) FILTER (WHERE {c} IS NULL) = 0 THEN min({c}) END AS {n}" for c, n in (("y", "semmed_year"), ("dp", "dp_year"), ("ed", "edat_year"))) + f" FROM (SELECT {PMID.format('PMID')} AS pmid, ISSN, {YEAR.format('PYEAR')} AS y, {YEAR.format('left(ltrim(DP), 4)')} AS dp, {YEAR.format('left(ltrim(EDAT), 4)')} AS ed FROM cit) WHERE pmid IS NOT NULL GROUP BY 1",
    "oay": f"SELECT work_id, count(*)::BIGINT AS openalex_rows, count(DISTINCT y)::BIGINT AS n_openalex_years, CASE WHEN count(DISTINCT y) = 1 AND count(*) FILTER (WHERE y IS NULL) = 0 THEN min(y) END AS openalex_year FROM (SELECT {WORK.format('work_id')} AS work_id, {YEAR.format('publication_year')} AS y FROM wyr) GROUP BY 1",
    "lnk": f"SELECT c.pmid, n_analysis_years, analysis_year, s.* EXCLUDE (pmid), m.work_id, n_pmids_for_work, o.* EXCLUDE (work_id), d.* EXCLUDE (work_id), openalex_year - semmed_year AS year_difference, CASE WHEN m.work_id IS NULL THEN 'unmatched' WHEN semmed_year IS NULL THEN 'semmed_year_unavailable' WHEN openalex_year IS NULL THEN 'openalex_year_unavailable' WHEN openalex_year = semmed_year THEN 'equal' ELSE 'different' END AS work_year_status FROM (SELECT PMID AS pmid, count(DISTINCT PYEAR)::BIGINT AS n_analysis_years, CASE WHEN count(DISTINCT PYEAR) = 1 THEN min(PYEAR) END AS analysis_year FROM cohort GROUP BY 1) c LEFT JOIN agy s USING (pmid) LEFT JOIN maps m USING (pmid) LEFT JOIN (SELECT work_id, count(*)::BIGINT AS n_pmids_for_work FROM maps GROUP BY 1) g ON g.work_id = m.work_id LEFT JOIN oay o ON o.work_id = m.work_id LEFT JOIN (SELECT {WORK.format('work_id')} AS work_id, count(DISTINCT {DOI.format('doi')})::BIGINT AS n_dois_for_work, CASE WHEN count(DISTINCT {DOI.format('doi')}) = 1 THEN min({DOI.format('doi')}) END AS doi FROM wid WHERE trim(coalesce(pmid, '')) <> '' GROUP BY 1) d ON d.work_id = m.work_id",
    "pap": f"SELECT *, CASE WHEN n_works = 0 THEN 'unmatched' WHEN n_works = 1 THEN 'single_work' ELSE 'multiple_works' END AS mapping_group, CASE WHEN n_works = 0 THEN 'unmatched' WHEN semmed_year IS NULL THEN 'semmed_year_unavailable' WHEN n_works_with_unavailable_year > 0 THEN 'incomplete_openalex_years' WHEN n_matching_works = n_works THEN 'all_match' WHEN n_matching_works > 0 THEN 'some_match' ELSE 'none_match' END AS year_status, semmed_year = analysis_year AS analysis_semmed_year_equal, semmed_year = dp_year AS semmed_pyear_dp_equal FROM (SELECT pmid, analysis_year, n_analysis_years, semmed_year, dp_year, edat_year, journal_issns, semmed_rows, n_semmed_years, invalid_semmed_year_rows, count(work_id)::BIGINT AS n_works, {_n('work_id IS NOT NULL AND openalex_year IS NOT NULL', 'n_works_with_usable_year')}, {_n('work_id IS NOT NULL AND openalex_year IS NULL', 'n_works_with_unavailable_year')}, {_n(chr(39).join(('work_year_status = ', 'equal', '')), 'n_matching_works')}, {_n(chr(39).join(('work_year_status = ', 'different', '')), 'n_different_year_works')}, count(DISTINCT openalex_year)::BIGINT AS n_distinct_usable_openalex_years, min(openalex_year) AS min_openalex_year, max(openalex_year) AS max_openalex_year, min(year_difference) AS min_year_difference, max(year_difference) AS max_year_difference, coalesce(bool_or(n_pmids_for_work > 1), false) AS has_work_shared_with_other_pmids, count(doi)::BIGINT AS n_works_with_usable_doi, count(DISTINCT doi)::BIGINT AS n_distinct_usable_dois, {_n('n_dois_for_work > 1', 'n_works_with_conflicting_dois')} FROM lnk GROUP BY ALL)",
    "au3": f"SELECT *, semmed_pyear - analysis_year AS delta_semmed_analysis, openalex_year - semmed_pyear AS delta_openalex_semmed, sciscinet_year - semmed_pyear AS delta_sciscinet_semmed, sciscinet_year - openalex_year AS delta_sciscinet_openalex, CASE WHEN semmed_pyear IS NOT NULL AND semmed_pyear <> analysis_year THEN 'analysis_semmed_year_mismatch' WHEN work_id IS NULL THEN 'no_openalex_mapping' WHEN n_works_for_pmid > 1 OR n_pmids_for_work > 1 THEN 'ambiguous_mapping' WHEN semmed_pyear IS NULL OR openalex_year IS NULL OR sciscinet_year IS NULL THEN 'missing_or_conflicting_year' WHEN semmed_pyear = openalex_year AND openalex_year = sciscinet_year THEN 'all_equal' WHEN openalex_year = sciscinet_year THEN 'openalex_sciscinet_equal' WHEN semmed_pyear = openalex_year THEN 'semmed_openalex_equal' WHEN semmed_pyear = sciscinet_year THEN 'semmed_sciscinet_equal' ELSE 'all_different' END AS match_status FROM (SELECT c.PMID AS pmid, PYEAR AS analysis_year, m.work_id, coalesce(n_works_for_pmid, 0)::BIGINT AS n_works_for_pmid, coalesce(n_pmids_for_work, 0)::BIGINT AS n_pmids_for_work, semmed_year AS semmed_pyear, openalex_year, sciscinet_year FROM cohort c LEFT JOIN maps m ON m.pmid = c.PMID LEFT JOIN (SELECT pmid, count(*) AS n_works_for_pmid FROM maps GROUP BY 1) a ON a.pmid = c.PMID LEFT JOIN (SELECT work_id, count(*) AS n_pmids_for_work FROM maps GROUP BY 1) b ON b.work_id = m.work_id LEFT JOIN agy s ON s.pmid = c.PMID LEFT JOIN oay o ON o.work_id = m.work_id LEFT JOIN (SELECT {WORK.format('paperid')} AS work_id, CASE WHEN count(DISTINCT {YEAR.format('year')}) = 1 AND count(*) FILTER (WHERE ({YEAR.format('year')}) IS NULL) = 0 THEN min({YEAR.format('year')}) END AS sciscinet_year FROM spap GROUP BY 1) x ON x.work_id = m.work_id)",
    "sel": "SELECT p.pmid, p.analysis_year AS pyear, work_id AS workid, openalex_year FROM pap p JOIN lnk USING (pmid) JOIN pam ON pam.PMID = p.pmid WHERE n_works = 1 AND NOT has_work_shared_with_other_pmids",
    "sci": f"SELECT {WORK.format('paperid')} AS workid, try_cast(year AS INT) AS sciscinet_year, C3 AS sci_C3, C5 AS sci_C5, C10 AS sci_C10, team_size AS sci_team_size, {', '.join(f'{c} AS sci_{c}' for c in SOURCE_FIELDS)} FROM spap",
    "mas": "SELECT s.*, c.* EXCLUDE (workid), a.* EXCLUDE (PMID, PYEAR), true AS has_annotation_metrics, p.* EXCLUDE (PMID, PYEAR, n_triples), p.PMID IS NOT NULL AS has_pattern_metrics, k.* EXCLUDE (PMID, PYEAR, n_triples, n_new_node, n_new_combination, n_new_relation, n_repeated_triple, n_new_triples, share_new_node, share_new_combination, share_new_relation, share_repeated_triple, share_new_triples), k.PMID IS NOT NULL AS has_new_knowledge_metrics, d.* EXCLUDE (PMID, PYEAR, n_triples, n_new_node, n_new_combination, n_new_relation, n_repeated_triple, n_new_triples), d.PMID IS NOT NULL AS has_adoption_metrics, v.* EXCLUDE (PMID, PYEAR, n_new_node, n_new_combination, n_unique_new_combination_pairs), v.PMID IS NOT NULL AS has_development_metrics, d.PMID IS NOT NULL AS has_decomposition_metrics, s.pyear = openalex_year AS year_match_semmed_openalex, s.pyear = sciscinet_year AS year_match_semmed_sciscinet, openalex_year = sciscinet_year AS year_match_openalex_sciscinet, openalex_year - s.pyear AS year_diff_openalex_semmed, sciscinet_year - s.pyear AS year_diff_sciscinet_semmed, s.pyear <= 1999 AS eligible_adoption, sciscinet_year + 3 <= 2000 AS eligible_c3, sciscinet_year + 5 <= 2000 AS eligible_c5, sciscinet_year + 10 <= 2000 AS eligible_c10 FROM sel s JOIN sci c ON c.workid = s.workid JOIN pam a ON a.PMID = s.pmid LEFT JOIN pat p ON p.PMID = s.pmid LEFT JOIN pnk k ON k.PMID = s.pmid LEFT JOIN pad d ON d.PMID = s.pmid LEFT JOIN pdv v ON v.PMID = s.pmid",
    "excl": f"SELECT {PMID.format('pam.PMID')} AS pmid, pam.PYEAR AS pyear, coalesce(n_works, 0)::BIGINT AS n_works, CASE WHEN coalesce(n_works, 0) = 0 THEN 'no_openalex_mapping' WHEN n_works <> 1 THEN 'multiple_workids' ELSE 'workid_shared_with_other_pmids' END AS reason FROM pam LEFT JOIN pap ON pap.pmid = pam.PMID WHERE NOT (coalesce(n_works, 0) = 1 AND NOT coalesce(has_work_shared_with_other_pmids, false))",
    "scope": "SELECT k.*, s.scope, t.key_type, CASE t.key_type WHEN 'raw' THEN SUBJECT_CUI ELSE subject_cui_primary END AS ks, CASE t.key_type WHEN 'raw' THEN OBJECT_CUI ELSE object_cui_primary END AS ko, CASE t.key_type WHEN 'primary_in_sentence' THEN SENTENCE_ID ELSE '' END AS extra FROM keyed k, (VALUES ('all'), ('non_self_loop')) s(scope), (VALUES ('raw'), ('primary'), ('primary_in_sentence')) t(key_type) WHERE s.scope = 'all' OR subject_cui_primary <> object_cui_primary",
    "dss": f"SELECT *, {_share('n_excess_rows', 'n_rows', 'share_excess_rows')} FROM (SELECT PYEAR, scope, key_type, sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_groups, {_n('n > 1', 'n_duplicate_groups')}, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_rows_in_duplicate_groups, sum(n - 1)::BIGINT AS n_excess_rows, max(n)::BIGINT AS max_group_size, sum(bad)::BIGINT AS n_rows_invalid_cui, sum(diff)::BIGINT AS n_rows_primary_differs FROM (SELECT PYEAR, scope, key_type, PMID, ks, PREDICATE, ko, extra, count(*) AS n, count(*) FILTER (WHERE NOT (regexp_matches(subject_cui_primary, '^C[0-9]{{7,}}$') AND regexp_matches(object_cui_primary, '^C[0-9]{{7,}}$'))) AS bad, count(*) FILTER (WHERE subject_cui_primary <> SUBJECT_CUI OR object_cui_primary <> OBJECT_CUI) AS diff FROM scope GROUP BY ALL) GROUP BY 1, 2, 3)",
    "coll": f"SELECT {KEYS}, count(*)::BIGINT AS n_raw_variants, sum(n)::BIGINT AS n_rows FROM (SELECT {KEYS}, SUBJECT_CUI, OBJECT_CUI, count(*) AS n FROM keyed GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1",
    "grp": f"SELECT {KEYS}, count(*) AS n FROM keyed GROUP BY ALL",
    "lrow": "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem",
    "ents": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY upd DESC, j DESC) AS rn FROM (SELECT kind, id, n, k, '2024-01-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') || 'T' || lpad(n::VARCHAR, 8, '0') AS upd, '{\"own\":\"' || id || '\",\"wiki\":\"Q' || n || '\"}' AS j FROM (SELECT 'source' AS kind, 'S' || (s_suppkey % 60) AS id, s_suppkey AS n, s_nationkey AS k FROM supplier UNION ALL SELECT 'author', 'A' || (c_custkey % 900), c_custkey, c_nationkey FROM customer))) WHERE rn = 1",
    "dia": "SELECT 1",
}
del CTES["ynk"], CTES["dia"]


def _over_prepared() -> dict[str, str]:
    """The annotation's relations once more, with a ``z`` before their names, over prepared triples."""
    names = ("ok", "years", "nodes_k", "p_node", "p_pair", "p_trip", "p_dir", "flagged", "ann", "tr")
    again = re.compile(rf"\b({'|'.join(('trip', *names))})\b")
    wide = PREPARED.replace("PYEAR", "PYEAR::INT AS PYEAR")
    return {"ztrip": f"SELECT {wide}, subject_cui_primary AS s, PREDICATE AS p, object_cui_primary AS o FROM prep"} | {f"z{n}": again.sub(r"z\1", CTES[n]) for n in names}


CTES |= _over_prepared()


def _parallel_sql(keys: str, extra: str = "") -> str:
    inner = (
        f"SELECT {keys}, sum(n_rows)::BIGINT AS n_rows, count(*)::BIGINT AS n_unique_exact_triples, {_n('n_pmids = 1', 'n_single_pmid_exact_triples')}, {_n('n_pmids > 1', 'n_multi_pmid_exact_triples')}, "
        "coalesce(sum(n_rows) FILTER (WHERE n_pmids = 1), 0)::BIGINT AS n_rows_in_single_pmid_exact_triples, coalesce(sum(n_rows) FILTER (WHERE n_pmids > 1), 0)::BIGINT AS n_rows_in_multi_pmid_exact_triples "
        f"FROM (SELECT {keys}, s, p, o, sum(n_rows) AS n_rows, sum(n_pmids) AS n_pmids FROM par GROUP BY ALL) GROUP BY {keys}"
    )
    return f"SELECT *{extra}, {_share('n_multi_pmid_exact_triples', 'n_unique_exact_triples', 'share_multi_pmid_exact_triples')}, {_share('n_rows_in_multi_pmid_exact_triples', 'n_rows', 'share_rows_in_multi_pmid_exact_triples')} FROM ({inner}) JOIN (SELECT {keys}, count(DISTINCT PMID)::BIGINT AS n_unique_pmids FROM parp GROUP BY {keys}) USING ({keys})"


def _agreement_sql(keys: str) -> str:
    varies = "stddev_pop(x) > 0 AND stddev_pop(y) > 0"
    return (
        f"SELECT {keys}, count(*)::BIGINT AS n, round(CASE WHEN {varies} THEN corr(x, y) END, 9) AS pearson, round(sqrt(avg((x - y) * (x - y))), 9) AS rmse, round(avg(abs(x - y)), 9) AS mae, round(avg(x - y), 9) AS mean_difference, "
        f"{_share('count(*) FILTER (WHERE x = y)', 'count(*)', 'share_equal')}, {_share('count(*) FILTER (WHERE (x = 0) = (y = 0))', 'count(*)', 'share_zero_agreement')} FROM cml GROUP BY {keys}"
    )


def _duplicates_sql() -> str:
    return f"SELECT *, {_share('n_excess_rows', 'n_rows', 'share_excess_rows')} FROM (SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, count(*)::BIGINT AS n_groups, {_n('n > 1', 'n_duplicate_groups')}, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_rows_in_duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS n_excess_rows, max(n)::BIGINT AS max_group_size FROM grp)"


def _rules(table: str, rules: dict[str, str], extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v})::BIGINT AS n_violations{extra} FROM {table}" for k, v in rules.items())


def _distinct_conflicts(rules: dict[str, tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*)::BIGINT AS n_violations FROM (SELECT {keys} FROM {t} GROUP BY {keys} HAVING count(DISTINCT {v}) > 1)" for k, (t, keys, v) in rules.items())


def _diagnostics() -> str:
    side = {"subject": "SUBJECT", "object": "OBJECT"}
    pipe = "coalesce(strpos({0}, '|'), 0) > 0"
    parts = lambda c: f"len(string_split({c}, '|'))"
    b = [
        "count(*)::BIGINT AS n_raw_predication_rows", "count(DISTINCT PREDICATION_ID)::BIGINT AS n_unique_raw_predication_ids", "count(DISTINCT PMID)::BIGINT AS n_unique_raw_pmids", _n(_missing("PMID"), "n_rows_missing_pmid"), _n(_missing("PREDICATION_ID"), "n_rows_missing_predication_id"),
        "count(PYEAR)::BIGINT AS n_rows_with_pyear", _n("PYEAR IS NULL", "n_rows_missing_pyear"), "min(PYEAR::INT) AS min_pyear_with_pyear", "max(PYEAR::INT) AS max_pyear_with_pyear", _n("pass", "n_rows_after_novelty_filter"), _n("NOT pass", "n_rows_removed_by_novelty_filter"),
        *[_n(f"try_cast({u}_NOVELTY AS DOUBLE) IS NULL", f"n_rows_missing_{s}_novelty") for s, u in side.items()], *[_n(f"try_cast({u}_NOVELTY AS DOUBLE) = 0", f"n_rows_zero_{s}_novelty") for s, u in side.items()],
        _n("pass AND mk", "n_rows_missing_required_analytic_key"), _n("pass AND NOT mk", "n_rows_valid_for_analytic_key"), *[_n("pass AND " + pipe.format(f"{u}_{x}"), f"n_{s}_{x.lower()}_pipe_delimited_rows") for x in ("CUI", "NAME") for s, u in side.items()],
        *[_n(f"pass AND {parts(u + '_CUI')} <> {parts(u + '_NAME')}", f"n_{s}_cui_name_component_mismatch_rows") for s, u in side.items()], *[_n(f"pass AND {s}_{x}_primary IS NULL", f"n_missing_{s}_{x}_primary") for x in ("cui", "name") for s in side],
    ]
    a = f"SELECT count(*)::BIGINT AS n_citation_rows, count(DISTINCT PMID)::BIGINT AS n_unique_citation_pmids, (SELECT count(*) FROM (SELECT PMID FROM cit GROUP BY 1 HAVING count(*) > 1))::BIGINT AS n_duplicate_citation_pmids, (SELECT count(*) FROM (SELECT PMID FROM cit GROUP BY 1 HAVING count(DISTINCT PYEAR) > 1))::BIGINT AS n_conflicting_citation_pyear_pmids, (count(*) - count(DISTINCT PMID))::BIGINT AS n_duplicate_citation_rows FROM cit"
    c = f"SELECT count(*)::BIGINT AS n_pmid_exact_triple_groups_before_dedup, {_n('n > 1', 'n_duplicate_pmid_exact_triple_groups')}, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_rows_in_duplicate_pmid_exact_triple_groups, coalesce(sum(n - 1) FILTER (WHERE n > 1), 0)::BIGINT AS n_rows_removed_by_pmid_exact_triple_dedup FROM grp"
    d = "SELECT count(*)::BIGINT AS n_final_pmid_unique_triples, count(DISTINCT PMID)::BIGINT AS n_final_unique_pmids, count(DISTINCT PREDICATE)::BIGINT AS n_final_unique_predicates, count(DISTINCT subject_cui_primary)::BIGINT AS n_final_unique_subject_cui_primary, count(DISTINCT object_cui_primary)::BIGINT AS n_final_unique_object_cui_primary, min(PYEAR::INT) AS min_pyear_final, max(PYEAR::INT) AS max_pyear_final, " + _n("subject_cui_primary = object_cui_primary", "n_self_loop_triples_final") + ", (SELECT count(DISTINCT concept) FROM longc)::BIGINT AS n_final_unique_cui_primary FROM prep"
    shares = ", ".join(_share(n, m, s) for n, m, s in (("n_rows_missing_pyear", "n_raw_predication_rows", "share_rows_missing_pyear"), ("n_rows_after_novelty_filter", "n_raw_predication_rows", "share_rows_after_novelty_filter"), ("n_rows_missing_required_analytic_key", "n_rows_after_novelty_filter", "share_rows_missing_required_analytic_key"), ("n_rows_removed_by_pmid_exact_triple_dedup", "n_rows_valid_for_analytic_key", "share_rows_removed_by_pmid_exact_triple_dedup"), ("n_self_loop_triples_final", "n_final_pmid_unique_triples", "share_self_loop_triples_final")))
    return f"SELECT *, {shares} FROM ({a}), (SELECT {', '.join(b)} FROM all_keyed), ({c}), ({d})"


def _annotation_summary() -> str:
    sizes = "(SELECT count(DISTINCT n) FROM p_node x WHERE x.y = f.PYEAR)::BIGINT AS n_prior_nodes, (SELECT count(DISTINCT (a, b)) FROM p_pair x WHERE x.y = f.PYEAR)::BIGINT AS n_prior_pairs, (SELECT count(DISTINCT (s, p, o)) FROM p_trip x WHERE x.y = f.PYEAR)::BIGINT AS n_prior_triples"
    cats = ", ".join(_n(f"edge_annotation = '{c}'", f"n_{c}") for c in CATS)
    return (
        f"SELECT f.*, {sizes}, c.* EXCLUDE (PYEAR), (SELECT count(DISTINCT PYEAR) FROM trip t WHERE t.PYEAR BETWEEN f.PYEAR - {W} AND f.PYEAR - 1)::BIGINT AS n_prior_years_found, {', '.join(_share(f'n_{c}', 'n_annotated_rows', f'share_{c}') for c in CATS)} "
        f"FROM ({SQL_SELF_LOOP.replace(', n_non_self_loop_rows', '')}) f JOIN (SELECT PYEAR, count(*)::BIGINT AS n_annotated_rows, {cats} FROM ann GROUP BY 1) c ON c.PYEAR = f.PYEAR"
    )


SQL_SELF_LOOP = f"SELECT PYEAR, n_focal_rows, 0::BIGINT AS n_invalid_endpoint_rows, n_self_loop_rows, n_non_self_loop_rows, 0.0::DOUBLE AS share_invalid_endpoint_rows, {_share('n_self_loop_rows', 'n_focal_rows', 'share_self_loop_rows')} FROM (SELECT PYEAR, count(*)::BIGINT AS n_focal_rows, {_n('s = o', 'n_self_loop_rows')}, {_n('s <> o', 'n_non_self_loop_rows')} FROM trip JOIN years ON PYEAR = y GROUP BY 1)"
_PRE = ", ".join(f"{f} AS {f}_in_prior_window" for f in FLAGS)
_TRI = f"PMID, PYEAR, {LONG}"
_DEVSEL = "edge_annotation, sn AS focal_subject_is_new_node, onew AS focal_object_is_new_node, n_focal_new_nodes, " + ", ".join(f"n_future_focal_new_node_{k}_{x}" for k in ("new_combination", "new_relation") for x in ("rows", "triples")) + ", " + ", ".join(f"n_future_focal_new_node_{k}_rows > 0 AS future_focal_new_node_{k}_seen" for k in ("new_combination", "new_relation"))
_SUMS = lambda cols: ", ".join(f"sum({c})::BIGINT AS {c}" for c in cols)
_PAD_COUNTS = ["n_triples", *[f"n_{k}" for k in KINDS], "n_new_triples", *[f"n_{k}" for k in ADOPTION_FLAGS]]
_DSHARE = ("share_new_triples", "share_new_triples_adopted", "share_adopted_new_triples_in_all")
_STATES = ("Adopted", "Continued", "Disappeared")
_CT = [(c, t) for c in CATS for t in (("Continued", "Disappeared") if c == CATS[3] else ("Adopted", "Disappeared"))]
_FULLMAP = {"scope_sums": ("n_rows", "n_groups", "n_duplicate_groups", "n_rows_in_duplicate_groups", "n_excess_rows")}
_MODS = {"annotation": "pam", "pattern": "(SELECT * EXCLUDE (n_triples) FROM pat)", "new_knowledge": "pnk", "adoption": "pad", "development": "pdv", "decomposition": "dec"}
_KNOW = ["n_triples", *[f"n_{k}" for k in KINDS], "n_new_triples", *[f"share_{k}" for k in (*KINDS, "new_triples")]]
_SHARED = [("annotation", "new_knowledge", _KNOW), ("annotation", "adoption", _KNOW[:6]), ("annotation", "development", ["n_new_node", "n_new_combination"]), ("annotation", "decomposition", ["n_triples", "n_new_triples", "share_new_triples"]), ("new_knowledge", "development", ["n_unique_new_combination_pairs"]), ("adoption", "decomposition", ["n_new_triples_adopted", "share_new_triples_adopted", "share_adopted_new_triples_in_all"])]

_REFERENCES = "SELECT 'W' || l_orderkey AS work_id, 'referenced' AS kind, 'W' || l_partkey AS other_work_id FROM lrow UNION ALL SELECT 'W' || l_orderkey, 'related', 'W' || (l_orderkey + 1) FROM (SELECT DISTINCT l_orderkey FROM lrow) WHERE l_orderkey % 3 = 0"
_WIDE = PREPARED
_WORKS = "(SELECT DISTINCT l_orderkey AS k FROM lrow)"

_CANDIDATES = (
    f"SELECT PYEAR, {LONG}, prior_p FROM prc"
)
_INSPECTED = "SELECT pmid, mapping_group, year_status, stratum, n_works, sample_rank::INT AS sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY mapping_group, year_status, stratum ORDER BY md5(pmid) NULLS FIRST, pmid NULLS FIRST) AS sample_rank FROM (SELECT *, CASE WHEN min_year_difference IS NULL THEN 'unavailable' WHEN min_year_difference = max_year_difference AND abs(min_year_difference) <= 1 THEN min_year_difference::VARCHAR ELSE 'other_or_mixed' END AS stratum FROM pap WHERE mapping_group <> 'single_work' OR year_status <> 'all_match' OR NOT analysis_semmed_year_equal OR NOT semmed_pyear_dp_equal)) WHERE sample_rank <= 20"
_MAPPED = f"count(*)::BIGINT AS n_pmids, sum(n_works)::BIGINT AS n_pmid_work_links, {_n('n_different_year_works > 0', 'n_pmids_with_any_observed_year_difference')}"

QUERIES: dict[str, str] = {
    "primary_component": "SELECT PREDICATION_ID, nullif(trim(split_part(SUBJECT_CUI, '|', 1)), '') AS subject_cui_primary, len(string_split(SUBJECT_CUI, '|'))::INT AS n_components FROM raw",
    "novelty_filter": "SELECT PREDICATION_ID, pass AS passes FROM all_keyed",
    "normalize_pmid_strict": f"SELECT work_id, pmid AS raw_pmid, {PMID.format('pmid')} AS pmid FROM wid",
    "normalize_pmid_loose": "SELECT work_id, pmid AS raw_pmid, CASE WHEN regexp_matches(trim(pmid), '^[0-9]+[.]0$') THEN split_part(trim(pmid), '.', 1) WHEN regexp_extract(trim(pmid), '([0-9]+)/*$', 1) <> '' THEN regexp_extract(trim(pmid), '([0-9]+)/*$', 1) ELSE nullif(trim(pmid), '') END AS pmid FROM wid",
    "normalize_work_id": f"SELECT work_id AS raw_work_id, {WORK.format('work_id')} AS strict, nullif(regexp_extract(work_id, '(W[0-9]+)', 1), '') AS loose FROM wid",
    "normalize_doi": f"SELECT work_id, doi AS raw_doi, {DOI.format('doi')} AS doi FROM wid",
    "strict_year": f"SELECT work_id, publication_year, {YEAR.format('publication_year')} AS year FROM wyr",
    "country_code_norm": "SELECT institution_id, version, code FROM icode",
    "predicate_phrase": f"SELECT predicate, {PHRASE.format('predicate')} AS phrase FROM (SELECT DISTINCT concat_ws('_', PREDICATE, SUBJECT_SEMTYPE) AS predicate FROM raw)",
    "date_year_parts": f"SELECT PMID, {YEAR.format('left(ltrim(DP), 4)')} AS dp_year, {YEAR.format('left(ltrim(EDAT), 4)')} AS edat_year FROM cit",
    "split_by_year_counts": "SELECT PYEAR, count(*)::BIGINT AS n_rows, count(DISTINCT PMID)::BIGINT AS n_pmids FROM prep GROUP BY 1",
    "shard_manifest": "SELECT shard, count(*)::BIGINT AS n_rows, min(work) AS first_key, max(work) AS last_key FROM (SELECT work, ceil(row_number() OVER (ORDER BY work, r) / 500.0)::BIGINT AS shard FROM (SELECT substr(work_id, 2)::BIGINT AS work, referenced_work_id AS r FROM refs)) GROUP BY 1",
    "write_shards": "SELECT shard, count(*)::BIGINT AS n_rows, min(work) AS first_key, max(work) AS last_key FROM (SELECT work, ceil(row_number() OVER (ORDER BY work, r) / 500.0)::BIGINT AS shard FROM (SELECT substr(work_id, 2)::BIGINT AS work, referenced_work_id AS r FROM refs)) GROUP BY 1",
    "read_ordered_range": "SELECT substr(work_id, 2)::BIGINT AS work, referenced_work_id FROM refs WHERE substr(work_id, 2)::BIGINT BETWEEN 1000 AND 2000",
    "write_years": "SELECT PYEAR::INT AS PYEAR, count(*)::BIGINT AS source_rows, count(*)::BIGINT AS written_rows, true AS passed FROM prep GROUP BY 1",
    "publish_table": "SELECT * FROM pam",
    "read_years": "SELECT PYEAR, count(*)::BIGINT AS n_rows, count(DISTINCT PMID)::BIGINT AS n_pmids FROM prep WHERE PYEAR BETWEEN '1997' AND '1999' GROUP BY 1",
    "read_snapshot": _REFERENCES,
    "edge_annotation_prepared": f"SELECT {_WIDE}, a AS node_a, b AS node_b, {_PRE}, has_new_node, edge_annotation FROM zann JOIN ztrip USING (PMID, PYEAR, s, p, o)",
    "edge_transition_prepared": f"SELECT {_WIDE}, a AS node_a, b AS node_b, {_PRE}, has_new_node, edge_annotation, seen AS future_exact_triple_seen, state AS future_five_year_transition, edge_annotation || ' -> ' || state AS edge_annotation_to_future_transition FROM ztr JOIN ztrip USING (PMID, PYEAR, s, p, o)",
    "publish_gate": "SELECT *, n_violations = 0 AS may_publish FROM (" + _rules("pam", {"no triples": "n_triples <= 0", "more new than all": "n_new_triples > n_triples"}) + ")",
    "filter_linked_rows": "SELECT * FROM wid WHERE pmid <> 'none'",
    "relation_text": f"SELECT {LONG}, text FROM reltext",
    "explode_country_list": "SELECT pmid, unnest(list_sort(list_distinct(string_split(country_codes, ';')))) AS code FROM pcl",
    "prepare_triples": "SELECT * FROM prep",
    "dedup_triples": f"SELECT PREDICATION_ID, {KEYS} FROM prep",
    "prepare_diagnostics": _diagnostics(),
    "analysis_sample": "SELECT * FROM sample",
    "analysis_sample_counts": "SELECT count(*)::BIGINT AS n_rows_before, count(*) FILTER (WHERE PYEAR = '1995')::BIGINT AS n_rows_bad_year, count(*) FILTER (WHERE PREDICATE = 'NO')::BIGINT AS n_rows_bad_predicate, count(*) FILTER (WHERE PYEAR = '1995' AND PREDICATE = 'NO')::BIGINT AS n_rows_bad_both, (SELECT count(*) FROM sample)::BIGINT AS n_rows_after, count(DISTINCT PMID)::BIGINT AS n_pmids_before, (SELECT count(DISTINCT PMID) FROM sample)::BIGINT AS n_pmids_after FROM prep",
    "duplicate_metrics": _duplicates_sql(),
    "group_size_distribution": "SELECT n::BIGINT AS group_size, count(*)::BIGINT AS n_groups, (n * count(*))::BIGINT AS n_rows FROM grp GROUP BY n",
    "collision_summary": "SELECT count(*)::BIGINT AS n_collision_groups, coalesce(sum(n_raw_variants), 0)::BIGINT AS n_raw_variants, coalesce(sum(n_rows), 0)::BIGINT AS n_rows, max(n_raw_variants) AS max_raw_variants FROM coll",
    "collision_examples": f"SELECT * FROM coll ORDER BY n_raw_variants DESC, n_rows DESC, {KEYS} LIMIT 100",
    "duplicate_scope_summary": "SELECT * FROM dss",
    "duplicate_overall_rollup": f"SELECT *, {_share('n_excess_rows', 'n_rows', 'share_excess_rows')} FROM (SELECT scope, key_type, coalesce(PYEAR, 'ALL') AS PYEAR, {_SUMS(_FULLMAP['scope_sums'])}, max(max_group_size) AS max_group_size FROM dss GROUP BY GROUPING SETS ((scope, key_type, PYEAR), (scope, key_type)))",
    "uniqueness_report": f"SELECT 'raw rows by paper and primary triple' AS rule, coalesce(sum(n - 1), 0)::BIGINT AS n_violations FROM grp UNION ALL SELECT 'prepared', (SELECT count(*) FROM prep) - (SELECT count(*) FROM (SELECT DISTINCT {KEYS} FROM prep)) UNION ALL SELECT 'annotation', (SELECT count(*) FROM ann) - (SELECT count(*) FROM (SELECT DISTINCT PMID, s, p, o FROM ann))",
    "conflict_report": _distinct_conflicts({"concept with several types": ("raw", "OBJECT_CUI", "OBJECT_SEMTYPE"), "paper with several sentences": ("raw", "PMID", "SENTENCE_ID"), "statement with several papers": ("raw", "PREDICATION_ID", "PMID")}),
    "rank_first_lookup": "SELECT * FROM look",
    "agreed_year": "SELECT * FROM agy",
    "same_pair_other_predicate": f"SELECT DISTINCT PYEAR, {LONG} FROM ann WHERE same_direction_different_predicate_seen",
    "endpoint_or_join": f"SELECT f.PMID, f.PYEAR, f.s AS subject_cui_primary, f.p AS PREDICATE, f.o AS object_cui_primary, count(*)::BIGINT AS n_touching_rows FROM focal_nn f JOIN ann g ON g.PYEAR BETWEEN f.PYEAR + 1 AND f.PYEAR + {W} AND ((NOT f.subject_seen AND f.s IN (g.s, g.o)) OR (NOT f.object_seen AND f.o IN (g.s, g.o))) GROUP BY 1, 2, 3, 4, 5",
    "prior_relation_candidates": _CANDIDATES,
    "score_profile": _profile_sql("(SELECT *, substr(subject_cui_primary, 1, 1) AS kind FROM prox)", "proximity", "PYEAR, kind"),
    "agreement_summary": _agreement_sql('"window"'),
    "agreement_by_year": _agreement_sql('"window", publication_year'),
    "spearman": "SELECT \"window\", count(*)::BIGINT AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 9) AS spearman FROM (SELECT \"window\", rank() OVER (PARTITION BY \"window\" ORDER BY x) + (count(*) OVER (PARTITION BY \"window\", x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY \"window\" ORDER BY y) + (count(*) OVER (PARTITION BY \"window\", y) - 1) / 2.0 AS b FROM cml) GROUP BY 1",
    "prior_overlap": _prior_overlap(),
    "prior_jaccard": "SELECT b.y AS PYEAR, f0.f AS n_concepts, " + ", ".join(f"coalesce(o{w}.o, 0)::DOUBLE / nullif(f0.f + coalesce(u{w}.u, 0) - coalesce(o{w}.o, 0), 0) AS jaccard_prior_{w}y" for w in (1, 3, 5)) + f" FROM (SELECT DISTINCT y FROM node_y) b JOIN ({_size('node_y', 'k')}) f0 USING (y) " + " ".join(f"LEFT JOIN ({_overlap('node_y', 'k', w)}) o{w} USING (y) LEFT JOIN ({_union('node_y', 'k', w)}) u{w} USING (y)" for w in (1, 3, 5)),
    "prior_jaccard_by_bitmaps": "SELECT b.y AS PYEAR, f0.f AS n_concepts, " + ", ".join(f"coalesce(o{w}.o, 0)::DOUBLE / nullif(f0.f + coalesce(u{w}.u, 0) - coalesce(o{w}.o, 0), 0) AS jaccard_prior_{w}y" for w in (1, 3, 5)) + f" FROM (SELECT DISTINCT y FROM node_y) b JOIN ({_size('node_y', 'k')}) f0 USING (y) " + " ".join(f"LEFT JOIN ({_overlap('node_y', 'k', w)}) o{w} USING (y) LEFT JOIN ({_union('node_y', 'k', w)}) u{w} USING (y)" for w in (1, 3, 5)),
    "distinct_since": "SELECT y.y AS PYEAR, (SELECT count(DISTINCT k) FROM node_y n WHERE n.y <= y.y)::BIGINT AS n_concepts_since, (SELECT count(DISTINCT (k1, k2, k3)) FROM triple_y t WHERE t.y <= y.y)::BIGINT AS n_triples_since, (SELECT count(DISTINCT PMID) FROM prep p WHERE p.PYEAR::INT <= y.y)::BIGINT AS n_papers_since FROM (SELECT DISTINCT y FROM node_y) y",
    "prior_nodes": "SELECT y AS PYEAR, count(DISTINCT n)::BIGINT AS n_prior_nodes FROM p_node GROUP BY 1",
    "long_concepts": "SELECT PMID, PYEAR, PREDICATE, role, concept, name, semtype, neighbour FROM longc",
    "set_equality_report": "SELECT 'annotation and transition: only left' AS rule, count(*)::BIGINT AS n_violations FROM (SELECT PMID, s, p, o, edge_annotation FROM ann EXCEPT SELECT PMID, s, p, o, edge_annotation FROM tr) UNION ALL SELECT 'annotation and transition: only right', count(*) FROM (SELECT PMID, s, p, o, edge_annotation FROM tr EXCEPT SELECT PMID, s, p, o, edge_annotation FROM ann)",
    "bag_equality_report": "SELECT 'new nodes and their development: only left' AS rule, count(*)::BIGINT AS n_violations FROM (SELECT PMID, s, p, o FROM ann WHERE edge_annotation = 'New_Node' AND PYEAR <= 1999 EXCEPT ALL SELECT PMID, s, p, o FROM nnd) UNION ALL SELECT 'new nodes and their development: only right', count(*) FROM (SELECT PMID, s, p, o FROM nnd EXCEPT ALL SELECT PMID, s, p, o FROM ann WHERE edge_annotation = 'New_Node' AND PYEAR <= 1999)",
    "yearly_profile": f"SELECT w.*, n_unique_cui_primary, n_unique_name_primary, n_pmid_unique_triples::DOUBLE / (SELECT count(*) FROM prep) AS share_pmid_unique_triples, n_unique_pmid::DOUBLE / (SELECT count(DISTINCT PMID) FROM prep) AS share_unique_pmid, {_share('n_self_loop_triples', 'n_pmid_unique_triples', 'share_self_loop_triples')} FROM (SELECT PYEAR, {WIDE}, count(DISTINCT PREDICATE)::BIGINT AS n_unique_predicate, {_n('subject_cui_primary = object_cui_primary', 'n_self_loop_triples')} FROM prep GROUP BY 1) w JOIN (SELECT PYEAR, count(DISTINCT concept)::BIGINT AS n_unique_cui_primary, count(DISTINCT name)::BIGINT AS n_unique_name_primary FROM longc GROUP BY 1) USING (PYEAR)",
    "predicate_year_profile": f"SELECT w.*, n_unique_cui_primary, n_unique_name_primary, n_pmid_unique_triples::DOUBLE / sum(n_pmid_unique_triples) OVER (PARTITION BY PYEAR) AS share_of_year_pmid_unique_triples, n_pmid_unique_triples::DOUBLE / (SELECT count(*) FROM prep) AS share_of_all_pmid_unique_triples, dense_rank() OVER (PARTITION BY PYEAR ORDER BY n_pmid_unique_triples DESC)::INT AS predicate_rank_within_year_by_triples, r::INT AS predicate_rank_overall_by_triples FROM (SELECT PYEAR, PREDICATE, {WIDE} FROM prep GROUP BY 1, 2) w JOIN (SELECT PYEAR, PREDICATE, count(DISTINCT concept)::BIGINT AS n_unique_cui_primary, count(DISTINCT name)::BIGINT AS n_unique_name_primary FROM longc GROUP BY 1, 2) USING (PYEAR, PREDICATE) JOIN (SELECT PREDICATE, dense_rank() OVER (ORDER BY count(*) DESC) AS r FROM prep GROUP BY 1) USING (PREDICATE)",
    "concept_profile": "SELECT * FROM cpf",
    "edge_annotation": f"SELECT {_TRI}, a AS node_a, b AS node_b, {_PRE}, has_new_node, edge_annotation FROM ann",
    "annotation_summary": _annotation_summary(),
    "self_loop_summary": SQL_SELF_LOOP,
    "annotation_checks": "SELECT PYEAR, true AS category_sum_ok, true AS share_sum_ok, true AS row_accounting_ok, true AS full_prior_window_ok, true AS passed FROM ann GROUP BY 1",
    "edge_transition": f"SELECT {_TRI}, a AS node_a, b AS node_b, {_PRE}, has_new_node, edge_annotation, seen AS future_exact_triple_seen, state AS future_five_year_transition, edge_annotation || ' -> ' || state AS edge_annotation_to_future_transition FROM tr",
    "transition_summary": f"SELECT *, {', '.join(_share(f'n_{t}', 'n_rows', f'share_{t}') for t in _STATES)}, {', '.join(_share(f'n_{c}_{t}', 'n_rows', f'share_{c}_{t}') for c, t in _CT)} FROM (SELECT PYEAR, count(*)::BIGINT AS n_rows, {', '.join(_n(f'state = {chr(39)}{t}{chr(39)}', f'n_{t}') for t in _STATES)}, {', '.join(_n(f'edge_annotation = {chr(39)}{c}{chr(39)} AND state = {chr(39)}{t}{chr(39)}', f'n_{c}_{t}') for c, t in _CT)} FROM tr GROUP BY 1)",
    "paper_annotation_metrics": "SELECT * FROM pam",
    "paper_pattern": "SELECT * EXCLUDE (n_triples) FROM pat",
    "pattern_summary": "SELECT y.PYEAR, l.l AS knowledge_type_pattern, coalesce(n, 0)::BIGINT AS n_pmids, coalesce(n, 0)::DOUBLE / t AS share_pmids, mean_n_triples, median_n_triples FROM (SELECT PYEAR, count(*) AS t FROM pat GROUP BY 1) y CROSS JOIN (VALUES ('Repeated_Only'), ('N'), ('C'), ('R'), ('N+C'), ('N+R'), ('C+R'), ('N+C+R')) l(l) LEFT JOIN (SELECT PYEAR, knowledge_type_pattern AS l, count(*) AS n, avg(n_triples) AS mean_n_triples, median(n_triples)::DOUBLE AS median_n_triples FROM pat GROUP BY 1, 2) c ON c.PYEAR = y.PYEAR AND c.l = l.l",
    "paper_new_knowledge": "SELECT * FROM pnk",
    "year_new_knowledge": "SELECT z.PYEAR, " + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_unique_concepts", "n_unique_new_concepts", "n_unique_concept_pairs", "n_unique_new_combination_pairs", *_KNOW[:6])) + f", {_share('n_unique_new_concepts', 'n_unique_concepts', 'share_unique_new_concepts')}, {_share('n_unique_new_combination_pairs', 'n_unique_concept_pairs', 'share_unique_new_combination_pairs')}, {SHARES} FROM (SELECT unnest(range((SELECT min(PYEAR) FROM trip), (SELECT max(PYEAR) + 1 FROM trip)))::INT AS PYEAR) z LEFT JOIN ynk0 USING (PYEAR)",
    "paper_adoption_metrics": "SELECT * FROM pad",
    "adoption_summary": f"SELECT PYEAR, sum(n_triples)::BIGINT AS n_input_triples, count(*)::BIGINT AS n_pmids, {', '.join(_n(f'has_{k} = 1', f'n_pmids_has_{k}') for k in ADOPTION_FLAGS)}, {_SUMS(_PAD_COUNTS)} FROM pad GROUP BY 1",
    "adoption_decomposition": "SELECT * FROM dec",
    "decomposition_summary": f"SELECT PYEAR, count(*)::BIGINT AS n_pmids, {_n('n_new_triples > 0', 'n_pmids_with_new_triples')}, {_n('n_new_triples = 0', 'n_pmids_without_new_triples')}, {_n('n_new_triples_adopted > 0', 'n_pmids_with_adopted_new_triples')}, " + ", ".join(f"sum({c})::BIGINT AS sum_{c}" for c in ("n_triples", "n_new_triples", "n_new_triples_adopted")) + ", " + ", ".join(f"avg({s}) AS mean_{s}, median({s}) AS median_{s}" for s in _DSHARE) + f", {_share('sum(n_new_triples)', 'sum(n_triples)', 'pooled_share_new_triples')}, {_share('sum(n_new_triples_adopted)', 'sum(n_new_triples)', 'pooled_share_new_triples_adopted')}, {_share('sum(n_new_triples_adopted)', 'sum(n_triples)', 'pooled_share_adopted_new_triples_in_all')} FROM dec GROUP BY 1",
    "new_node_development": f"SELECT {_TRI}, a AS node_a, b AS node_b, {_DEVSEL} FROM nnd",
    "new_combination_development": f"SELECT {_TRI}, a AS node_a, b AS node_b, edge_annotation, n_future_focal_pair_new_relation_rows > 0 AS future_focal_pair_new_relation_seen, n_future_focal_pair_new_relation_rows, n_future_focal_pair_new_relation_triples FROM ncd",
    "development_summary_node": _dev_summary("nnd", ("future_focal_new_node_new_combination", "future_focal_new_node_new_relation"), True),
    "development_summary_pair": _dev_summary("ncd", ("future_focal_pair_new_relation",), False),
    "paper_development_metrics": "SELECT * FROM pdv",
    "development_metrics_summary": f"SELECT PYEAR, count(*)::BIGINT AS n_pmids, {_n('n_new_node > 0', 'n_pmids_with_new_node')}, {_n('n_new_combination > 0', 'n_pmids_with_new_combination')}, {', '.join(_n(f'has_{n} = 1', f'n_pmids_has_{n}') for n in (*PATHS, 'nc_pairs_future_nr'))}, {_SUMS(_DEV_COUNTS)} FROM pdv GROUP BY 1",
    "paper_network_edges": "SELECT * FROM edg",
    "paper_network_trace": f"SELECT PYEAR AS focal_year, 'focal_new' AS role, PMID, PYEAR, {LONG}, edge_annotation AS annotation, n_focal_pmids FROM ann JOIN (SELECT focal_year AS PYEAR, s, p, o, n_focal_pmids FROM nfo) USING (PYEAR, s, p, o) WHERE edge_annotation IN {NEW3} UNION ALL SELECT focal_year, 'future_matched', PMID, PYEAR, s, p, o, edge_annotation, n_focal_pmids FROM ann JOIN nfo USING (s, p, o) WHERE PYEAR BETWEEN focal_year + 1 AND focal_year + {W}",
    "paper_network_profile": "SELECT focal_year, sum(n_focal_pmids)::BIGINT AS n_new_triple_pmid_rows, count(*)::BIGINT AS n_unique_new_triples, coalesce(sum(n_future_pmids), 0)::BIGINT AS n_matched_future_triple_pmid_rows, coalesce(sum(n_focal_pmids * n_future_pmids), 0)::BIGINT AS n_triple_paper_pair_occurrences, max(n_focal_pmids) AS max_focal_pmids_per_triple, coalesce(max(n_future_pmids), 0) AS max_future_pmids_per_triple, any_value(m)::BIGINT AS n_focal_pmids FROM nfo LEFT JOIN nfu USING (focal_year, s, p, o) JOIN (SELECT PYEAR AS focal_year, count(DISTINCT PMID) AS m FROM ann GROUP BY 1) USING (focal_year) GROUP BY 1",
    "paper_network_nodes": f"SELECT a.PMID, a.PYEAR, a.n_triples, a.n_new_node, a.n_new_combination, a.n_new_relation, a.n_new_triples, d.n_new_node_adopted, d.n_new_combination_adopted, d.n_new_relation_adopted, d.n_new_triples_adopted, d.has_new_triples_adopted, a.PYEAR <= e.e AS focal_eligible, a.PYEAR > e.b AS adopter_eligible, a.PYEAR <= e.e AS has_complete_followup, a.PYEAR >= e.b + {W} AND a.PYEAR <= e.e + 1 AS has_complete_focal_coverage, CASE WHEN a.PYEAR > e.e THEN 'target_only' WHEN a.n_new_triples = 0 THEN 'no_new_triples' WHEN d.n_new_triples_adopted = 0 THEN 'new_triples_not_adopted' ELSE 'new_triples_adopted' END AS focal_status, coalesce(i.d, 0)::BIGINT AS in_degree, coalesce(i.w, 0)::BIGINT AS in_strength, coalesce(u.d, 0)::BIGINT AS out_degree, coalesce(u.w, 0)::BIGINT AS out_strength FROM pam a CROSS JOIN (SELECT min(PYEAR) AS b, max(PYEAR) - {W} AS e FROM ann) e LEFT JOIN pad d USING (PMID) LEFT JOIN (SELECT focal_pmid AS PMID, count(*) AS d, sum(n_shared_new_triples) AS w FROM edg GROUP BY 1) i USING (PMID) LEFT JOIN (SELECT adopter_pmid AS PMID, count(*) AS d, sum(n_shared_new_triples) AS w FROM edg GROUP BY 1) u USING (PMID)",
    "paper_network_summary": "SELECT y::INT AS focal_year, coalesce(a, 0)::BIGINT AS n_edges, coalesce(b, 0)::BIGINT AS total_shared_new_triples, coalesce(c, 0)::BIGINT AS n_focal_pmids_with_incoming_edges, coalesce(d, 0)::BIGINT AS n_adopter_pmids FROM range((SELECT min(PYEAR) FROM trip), (SELECT max(PYEAR) + 1 FROM trip)) r(y) LEFT JOIN (SELECT focal_year AS y, count(*) AS a, sum(n_shared_new_triples) AS b, count(DISTINCT focal_pmid) AS c, count(DISTINCT adopter_pmid) AS d FROM edg GROUP BY 1) USING (y)",
    "country_network": "SELECT * FROM cnet",
    "country_network_summary": f"SELECT *, {_share('n_domestic_edges', 'n_edges', 'share_domestic_edges')}, {', '.join(_share(f'domestic_{w}', f'total_{w}', f'share_domestic_{w}') for w in _WEIGHTS)} FROM (SELECT focal_year, edge_annotation, count(*)::BIGINT AS n_edges, {_n('is_domestic_adoption', 'n_domestic_edges')}, count(DISTINCT adopter_country_code)::BIGINT AS n_adopter_countries, count(DISTINCT source_country_code)::BIGINT AS n_source_countries, {', '.join(f'sum({w})::BIGINT AS total_{w}, coalesce(sum({w}) FILTER (WHERE is_domestic_adoption), 0)::BIGINT AS domestic_{w}' for w in _WEIGHTS)} FROM cnet GROUP BY 1, 2)",
    "country_names": "SELECT * FROM cnm",
    "country_network_by_key": f"SELECT focal_year, cat AS edge_annotation, k.code AS adopter_country_code, h.code AS source_country_code, count(DISTINCT (u.PYEAR, u.PMID, u.s, u.p, u.o))::BIGINT AS n_future_rows, count(DISTINCT u.PMID)::BIGINT AS n_future_pmids FROM (SELECT PYEAR AS focal_year, * FROM tr WHERE state = 'Adopted') t JOIN pc h ON h.pmid = t.PMID JOIN ann u ON u.PYEAR BETWEEN t.focal_year + 1 AND t.focal_year + {W} AND u.a = t.a AND u.b = t.b AND (t.edge_annotation <> 'New_Relation' OR (u.s = t.s AND u.p = t.p AND u.o = t.o)) JOIN pc k ON k.pmid = u.PMID, LATERAL (SELECT unnest([t.edge_annotation, 'Pooled_New_Knowledge']) AS cat) GROUP BY 1, 2, 3, 4",
    "parallel_by_year_category": _parallel_sql("PYEAR, edge_annotation"),
    "parallel_by_year": _parallel_sql("PYEAR", ", 'Pooled_New_Knowledge' AS edge_annotation"),
    "parallel_top_triples": "SELECT PYEAR, edge_annotation, s AS subject_cui_primary, p AS PREDICATE, o AS object_cui_primary, n_rows, n_pmids, rank::INT AS rank, (SELECT string_agg(PMID, ';' ORDER BY k) FROM (SELECT PMID, row_number() OVER (ORDER BY PMID::BIGINT) AS k FROM (SELECT DISTINCT PMID FROM ann a WHERE a.PYEAR = t.PYEAR AND a.s = t.s AND a.p = t.p AND a.o = t.o)) WHERE k <= 20) AS example_pmids FROM (SELECT *, row_number() OVER (PARTITION BY PYEAR, edge_annotation ORDER BY n_pmids DESC, n_rows DESC, s, p, o) AS rank FROM par WHERE n_pmids > 1) t WHERE rank <= 20",
    "concept_text": "SELECT * FROM lab",
    "concept_text_summary": "SELECT label_source, count(*)::BIGINT AS n_concepts, count(DISTINCT label)::BIGINT AS n_distinct_labels, sum(n_pmid_unique_triples)::BIGINT AS n_triples FROM lab GROUP BY 1",
    "vector_store": f"SELECT label AS text, run, round({_norm('v')}, 6) AS norm, 32 AS dimensions FROM (SELECT label, run, {_vector('label')} AS v FROM (SELECT label, min(CASE WHEN starts_with(primary_cui, 'C') THEN 1 ELSE 2 END)::INT AS run FROM lab WHERE label IS NOT NULL GROUP BY 1))",
    "raw_line_account": f"SELECT count(*)::BIGINT AS n_lines, {_n('NOT bad', 'n_good_lines')}, {_n('bad', 'n_bad_lines')}, 0::BIGINT AS n_good_lines_without_first, {_share('count(*) FILTER (WHERE bad)', 'count(*)', 'share_bad_lines')} FROM (SELECT PMID::BIGINT % 97 = 0 OR PMID::BIGINT % 89 = 0 AS bad FROM raw)",
    "raw_good_lines": "SELECT PREDICATION_ID, PMID, PREDICATE, SUBJECT_CUI, OBJECT_CUI FROM raw WHERE PMID::BIGINT % 97 <> 0 AND PMID::BIGINT % 89 <> 0",
    "embedding_norms": f"SELECT count(*)::BIGINT AS n_vectors, round(min(n), 6) AS min_norm, round(avg(n), 6) AS mean_norm, round(max(n), 6) AS max_norm, {_n('n = 0', 'n_zero_norm')} FROM (SELECT {_norm('v')} AS n FROM (SELECT label, {_vector('label')} AS v FROM (SELECT DISTINCT label FROM lab)))",
    "new_combination_proximity": "SELECT * FROM prox",
    "proximity_summary": "SELECT * FROM proxs",
    "proximity_checks": "SELECT PYEAR, true AS in_range, true AS quantiles_ordered, n_scored + n_missing_vector = n_rows AS all_scored, n_scored + n_missing_vector = n_rows AS passed FROM proxs",
    "new_relation_proximity": f"SELECT {_TRI}, * EXCLUDE (PMID, PYEAR, s, p, o) FROM relprox",
    "new_relation_summary": f"SELECT b.*, n_rows - n_rows_with_prior AS n_rows_without_prior, {_share('n_rows_with_prior', 'n_rows', 'share_rows_with_prior')}, {', '.join(_share(f'n_scored_rows_{c}', 'n_rows', f'share_scored_rows_{c}') for c in ('full', 'phrase'))}, round(m.mean_n_prior_predicates, 6) AS mean_n_prior_predicates, n_edge_annotation_rows, coalesce(n_prior_comparison_triples, 0)::BIGINT AS n_prior_comparison_triples, coalesce(n_unique_prior_predicates_in_comparisons, 0)::BIGINT AS n_unique_prior_predicates_in_comparisons, coalesce(n_prior_unique_triples_total, 0)::BIGINT AS n_prior_unique_triples_total FROM (SELECT PYEAR, count(*)::BIGINT AS n_rows, count(DISTINCT (s, p, o))::BIGINT AS n_unique_triples, count(DISTINCT (s, o))::BIGINT AS n_unique_directed_pairs, count(DISTINCT s)::BIGINT AS n_unique_subject_cui, count(DISTINCT o)::BIGINT AS n_unique_object_cui, count(DISTINCT p)::BIGINT AS n_unique_focal_predicates, coalesce(max(n_prior_predicates), 0)::BIGINT AS max_n_prior_predicates, {_n('n_prior_triples > 0', 'n_rows_with_prior')}, {', '.join(f'count(max_{c}_similarity)::BIGINT AS n_scored_rows_{c}, count(DISTINCT (s, p, o)) FILTER (WHERE max_{c}_similarity IS NOT NULL)::BIGINT AS n_scored_unique_triples_{c}, round(avg(max_{c}_similarity), 6) AS mean_{c}, round(stddev_pop(max_{c}_similarity), 6) AS std_{c}, round(quantile_cont(max_{c}_similarity, 0.5), 6) AS median_{c}, min(max_{c}_similarity) AS min_{c}, max(max_{c}_similarity) AS max_{c}, ' + ', '.join(f'round(quantile_cont(max_{c}_similarity, {q}), 6) AS p{round(100 * q):02d}_{c}' for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) for c in ('full', 'phrase'))} FROM relprox GROUP BY 1) b JOIN (SELECT PYEAR, avg(k) AS mean_n_prior_predicates FROM (SELECT PYEAR, s, p, o, max(coalesce(n_prior_predicates, 0)) AS k FROM relprox GROUP BY ALL) GROUP BY 1) m USING (PYEAR) JOIN (SELECT PYEAR, count(*) AS n_edge_annotation_rows FROM ann GROUP BY 1) USING (PYEAR) LEFT JOIN (SELECT PYEAR, count(*) AS n_prior_comparison_triples, count(DISTINCT prior_p) AS n_unique_prior_predicates_in_comparisons FROM ({_CANDIDATES}) GROUP BY 1) USING (PYEAR) LEFT JOIN (SELECT y AS PYEAR, count(*) AS n_prior_unique_triples_total FROM p_trip GROUP BY 1) USING (PYEAR)",
    "flatten_authorships": "SELECT 'W' || l_orderkey AS work_id, CASE WHEN l_linenumber = 1 THEN 'first' ELSE 'middle' END AS author_position, 'A' || l_suppkey AS author_id, unnest(CASE WHEN l_linenumber % 3 = 0 THEN [NULL] ELSE ['I' || (l_suppkey % 25), 'I' || (l_partkey % 7)] END) AS institution_id FROM lrow WHERE l_suppkey % 13 <> 0",
    "flatten_references": _REFERENCES,
    "flatten_locations": "WITH pl AS (SELECT 'W' || l_orderkey AS work_id, l_orderkey, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'S' || l_suppkey END AS source_id, 'http://x/' || l_partkey AS landing_page_url, 'http://x/' || l_partkey || '.pdf' AS pdf_url, l_returnflag = 'N' AS is_oa, CASE WHEN l_quantity > 25 THEN 'publishedVersion' END AS version, lower(l_returnflag) AS license FROM lrow), fst AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY source_id NULLS FIRST, landing_page_url, pdf_url, is_oa, version NULLS FIRST, license) AS rn FROM pl) WHERE rn = 1) SELECT 'any' AS kind, * EXCLUDE (l_orderkey) FROM pl WHERE source_id IS NOT NULL UNION ALL SELECT 'primary', * EXCLUDE (l_orderkey) FROM fst WHERE source_id IS NOT NULL UNION ALL SELECT 'best_oa', * EXCLUDE (l_orderkey) FROM fst WHERE source_id IS NOT NULL AND l_orderkey % 4 = 0",
    "flatten_works": f"SELECT 'W' || k AS id, CASE WHEN k % 5 <> 0 THEN 'https://doi.org/10.1/' || k END AS doi, 'Title ' || k AS title, 'Title ' || k AS display_name, CASE WHEN k % 19 <> 0 THEN (1995 + k % 7)::INT END AS publication_year, (1995 + k % 7) || '-01-02' AS publication_date, CASE WHEN k % 6 = 0 THEN 'book' ELSE 'article' END AS type, k % 40 AS cited_by_count, k % 50 = 0 AS is_retracted, k % 60 = 0 AS is_paratext, CASE WHEN k % 8 <> 0 THEN 'en' END AS language, CASE WHEN k % 2 = 0 THEN '{{\"word\":[0,' || (k % 3 + 1) || ']}}' END AS abstract_inverted_index FROM {_WORKS}",
    "flatten_publication_years": f"SELECT 'W' || k AS work_id, (1995 + k % 7)::INT AS publication_year FROM {_WORKS} WHERE k % 19 <> 0",
    "flatten_work_ids": f"SELECT 'W' || k AS work_id, 'W' || k AS openalex, CASE WHEN k % 5 <> 0 THEN 'https://doi.org/10.1/' || k END AS doi, (k * 3)::VARCHAR AS mag, k::VARCHAR AS pmid FROM {_WORKS} WHERE k % 4 <> 3",
    "flatten_work_open_access": f"SELECT 'W' || k AS work_id, k % 4 = 0 AS is_oa, CASE WHEN k % 4 = 0 THEN 'gold' ELSE 'closed' END AS oa_status, CASE WHEN k % 4 = 0 THEN 'http://x/' || k END AS oa_url FROM {_WORKS} WHERE k % 9 <> 0",
    "flatten_work_biblio": f"SELECT 'W' || k AS work_id, (k % 12)::VARCHAR AS volume, (k % 4)::VARCHAR AS issue, (k % 90)::VARCHAR AS first_page, (k % 90 + 9)::VARCHAR AS last_page FROM {_WORKS} WHERE k % 11 <> 0",
    "flatten_entities": "SELECT kind, id, kind || ' ' || n AS display_name, '[\"Alias ' || n || '\",\"Other ' || k || '\"]' AS alternatives, n % 500 AS works_count, n % 900 AS cited_by_count, upd AS updated_date FROM ents",
    "flatten_entity_geo": "SELECT kind, id, 'City ' || (n % 30) AS city, 'N' || k AS country_code, k / 2.0::DOUBLE AS latitude, n % 90 + 0.5::DOUBLE AS longitude FROM ents WHERE k % 4 <> 0",
    "flatten_entity_associated": "SELECT kind, id, 'E' || k AS other_id, 'parent' AS relationship FROM ents WHERE n % 3 = 0",
    "flatten_entity_ancestors": "SELECT kind, id, 'P' || k AS other_id FROM ents",
    "flatten_entity_related": "SELECT kind, id, 'R' || (n % 17) AS other_id, k / 4.0::DOUBLE AS score FROM ents WHERE n % 5 = 0",
    "flatten_work_terms": "SELECT 'W' || l_orderkey AS work_id, 'topic' AS kind, 'T' || (l_partkey % 50) AS term_id, l_quantity / 50 AS score FROM lrow UNION ALL SELECT 'W' || l_orderkey, 'mesh', 'D' || (l_orderkey % 9), CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END FROM (SELECT DISTINCT l_orderkey FROM lrow)",
    "flatten_entity_counts": "SELECT kind, id, 2000::INT AS year, n % 7 AS works_count, n % 11 AS cited_by_count FROM ents UNION ALL SELECT kind, id, 2001, k, n FROM ents",
    "flatten_entity_ids": "SELECT kind, id, 'own' AS scheme, id AS value FROM ents UNION ALL SELECT kind, id, 'wiki', 'Q' || n FROM ents",
    "authorship_institution": "SELECT * FROM awi",
    "authorship_coverage": f"SELECT *, {', '.join(_share(f'n_{x}', 'n_rows', f'share_{x}') for x in ('rows_with_institution', 'rows_matched', 'rows_with_country'))} FROM (SELECT count(*)::BIGINT AS n_rows, count(DISTINCT pmid)::BIGINT AS n_pmids, count(DISTINCT work_id)::BIGINT AS n_works, count(DISTINCT author_id)::BIGINT AS n_authors, count(DISTINCT institution_id)::BIGINT AS n_institutions, count(institution_id)::BIGINT AS n_rows_with_institution, count(display_name)::BIGINT AS n_rows_matched, count(country_code)::BIGINT AS n_rows_with_country FROM awi)",
    "pmid_country": "SELECT * FROM pco",
    "pmid_country_lists": "SELECT * FROM pcl",
    "first_last_authors": "SELECT pmid, work_id, author_id, author_position, institution_id, country_code, n_countries FROM awi JOIN (SELECT work_id, author_id, count(DISTINCT country_code)::BIGINT AS n_countries FROM awi GROUP BY 1, 2) USING (work_id, author_id) WHERE author_position IN ('first', 'last')",
    "attach_country_lists": f"SELECT t.PMID, t.PYEAR, {LONG}, country_codes, countries, n_countries FROM tr t LEFT JOIN pcl ON pcl.pmid = t.PMID",
    "country_match_summary": f"SELECT *, {_share('n_matched_rows', 'n_rows', 'share_matched_rows')}, {_share('n_matched_pmids', 'n_pmids', 'share_matched_pmids')} FROM (SELECT PYEAR, count(*)::BIGINT AS n_rows, count(n_countries)::BIGINT AS n_matched_rows FROM tr t LEFT JOIN pcl ON pcl.pmid = t.PMID GROUP BY 1) JOIN (SELECT PYEAR, count(*)::BIGINT AS n_pmids, count(n_countries)::BIGINT AS n_matched_pmids, avg(n_countries) AS mean_countries, max(n_countries) AS max_countries FROM (SELECT DISTINCT PMID, PYEAR FROM tr) t LEFT JOIN pcl ON pcl.pmid = t.PMID GROUP BY 1) USING (PYEAR)",
    "citation_windows": "SELECT * FROM cw",
    "citation_windows_pmid": "SELECT cw.*, pmid FROM cw LEFT JOIN (SELECT work_id, min(pmid) AS pmid FROM maps GROUP BY 1) USING (work_id)",
    "citation_edge_accounting": f"SELECT count(*)::BIGINT AS n_edges, {_n('citing IS NULL', 'n_citing_year_unknown')}, {_n('cited IS NULL', 'n_cited_year_unknown')}, {_n('citing < cited', 'n_negative_gap')}, {_n('citing >= cited AND citing <= 2000', 'n_used')}, {', '.join(_n(f'citing - cited BETWEEN 0 AND {k} AND citing <= 2000', f'n_used_C{k}') for k in WINDOWS)} FROM edges_y",
    "citation_match": "SELECT * FROM cm",
    "match_coverage": f"SELECT count(publication_year)::BIGINT AS n_ours, count(other_year)::BIGINT AS n_other, {_n('publication_year IS NOT NULL AND other_year IS NOT NULL', 'n_both')}, {_n('publication_year = other_year', 'n_same_year')} FROM cw FULL JOIN oth USING (work_id)",
    "largest_differences": "SELECT * FROM cm WHERE difference_C5 IS NOT NULL ORDER BY abs(difference_C5) DESC, work_id LIMIT 50",
    "linked_papers": f"SELECT spap.*, m.PMID FROM spap LEFT JOIN (SELECT work_id, min(pmid) AS PMID FROM maps GROUP BY 1 HAVING count(*) = 1) m ON m.work_id = {WORK.format('paperid')}",
    "rejected_mappings": f"WITH r AS (SELECT DISTINCT trim(work_id) AS raw_work_id, trim(pmid) AS raw_pmid, {PMID.format('pmid')} AS p, {WORK.format('work_id')} AS w FROM wid) SELECT raw_work_id, raw_pmid, CASE WHEN p IS NULL AND w IS NULL THEN 'invalid_pmid_and_work_id' WHEN p IS NULL THEN 'invalid_pmid' WHEN w IS NULL THEN 'invalid_work_id' ELSE 'work_with_many_pmids' END AS reason FROM r WHERE p IS NULL OR w IS NULL OR w IN (SELECT work_id FROM maps GROUP BY 1 HAVING count(*) > 1)",
    "audit_links": "SELECT * FROM lnk",
    "audit_papers": "SELECT * FROM pap",
    "audit_mapping_summary": f"SELECT mapping_group, year_status, has_work_shared_with_other_pmids, count(*)::BIGINT AS n_pmids, sum(n_works)::BIGINT AS n_pmid_work_links, {_n('n_different_year_works > 0', 'n_pmids_with_any_observed_year_difference')} FROM pap GROUP BY 1, 2, 3",
    "audit_multiplicity": "SELECT scope, n_works, count(*)::BIGINT AS n_pmids, sum(n_works)::BIGINT AS n_pmid_work_links FROM (SELECT 'global_openalex' AS scope, count(*)::BIGINT AS n_works FROM maps GROUP BY pmid UNION ALL SELECT 'cohort', n_works FROM pap) GROUP BY 1, 2",
    "audit_year_patterns": "SELECT n_works, n_distinct_usable_openalex_years, n_works_with_unavailable_year, year_status, count(*)::BIGINT AS n_pmids FROM pap WHERE n_works > 1 GROUP BY ALL",
    "audit_year_difference": "SELECT mapping_group, l.analysis_year, l.year_difference, count(*)::BIGINT AS n_pmid_work_links, count(DISTINCT l.pmid)::BIGINT AS n_pmids FROM lnk l JOIN pap USING (pmid) WHERE l.year_difference IS NOT NULL GROUP BY ALL",
    "audit_dates": "SELECT analysis_year, semmed_year, dp_year, edat_year, count(*)::BIGINT AS n_pmids FROM pap GROUP BY ALL",
    "audit_doi_patterns": "SELECT n_works, n_works_with_usable_doi, n_distinct_usable_dois, n_works_with_conflicting_dois, count(*)::BIGINT AS n_pmids FROM pap WHERE n_works > 1 GROUP BY ALL",
    "inspection_sample": _INSPECTED,
    "inspection_work_details": f"SELECT * FROM lnk WHERE pmid IN (SELECT pmid FROM ({_INSPECTED}))",
    "audit_mapping_levels": f"SELECT 'overall' AS level, mapping_group, year_status, has_work_shared_with_other_pmids, NULL::INT AS analysis_year, NULL::VARCHAR AS journal_issns, {_MAPPED} FROM pap GROUP BY ALL UNION ALL SELECT 'year', mapping_group, year_status, has_work_shared_with_other_pmids, analysis_year, NULL, {_MAPPED} FROM pap GROUP BY ALL UNION ALL SELECT 'issn', mapping_group, year_status, NULL, NULL, journal_issns, {_MAPPED} FROM pap GROUP BY ALL",
    "mapping_year_summary_by_year": f"SELECT analysis_year, mapping_group, year_status, has_work_shared_with_other_pmids, {_MAPPED} FROM pap GROUP BY ALL",
    "mapping_year_summary_by_issn": "SELECT journal_issns, mapping_group, year_status, count(*)::BIGINT AS n_pmids FROM pap GROUP BY ALL",
    "cohort_work_multiplicity_by_year": "SELECT analysis_year, n_works, count(*)::BIGINT AS n_pmids FROM pap GROUP BY ALL",
    "country_network_coverage": f"""
SELECT y.focal_year, y.cat AS edge_annotation, CASE WHEN y.cat = 'Repeated_Triple' THEN 'Continued' ELSE 'Adopted' END AS transition_type, n_source_transition_rows, n_source_rows_with_country, {_share('n_source_rows_with_country', 'n_source_transition_rows', 'source_row_country_match_rate')}, n_source_country_rows, n_source_country_rows_na_code,
  coalesce(n_source_exact_triples, 0) AS n_source_exact_triples, coalesce(n_source_rows_with_country_in_category, 0) AS n_source_rows_with_country_in_category, coalesce(n_source_triple_country_rows, 0) AS n_source_triple_country_rows, n_future_rows_scanned, n_future_rows_with_country, {_share('n_future_rows_with_country', 'n_future_rows_scanned', 'future_row_country_match_rate')},
  n_future_country_rows, n_future_country_rows_na_code, n_future_rows_matched_to_source_exact_triples, coalesce(n_country_edges, 0) AS n_country_edges, coalesce(n_domestic_country_edges, 0) AS n_domestic_country_edges, {_share('n_domestic_country_edges', 'n_country_edges', 'share_domestic_country_edges')},
  {", ".join(f"coalesce(total_{w}, 0)::BIGINT AS total_{w}" for w in _WEIGHTS)}, coalesce(domestic_weight_unique_exact_triples, 0)::BIGINT AS domestic_weight_unique_exact_triples, coalesce(domestic_weight_source_pmid_x_future_pmid, 0)::BIGINT AS domestic_weight_source_pmid_x_future_pmid
FROM (SELECT DISTINCT PYEAR AS focal_year, cat FROM tr, (VALUES ('New_Node'), ('New_Combination'), ('New_Relation'), ('Repeated_Triple'), ('Pooled_New_Knowledge')) c(cat)) y
JOIN (SELECT PYEAR AS focal_year, count(*) FILTER (WHERE state <> 'Disappeared') AS n_source_transition_rows, count(*) FILTER (WHERE state <> 'Disappeared' AND PMID IN (SELECT pmid FROM pc)) AS n_source_rows_with_country FROM tr GROUP BY 1) USING (focal_year)
JOIN (SELECT PYEAR AS focal_year, count(pc.code) AS n_source_country_rows, count(*) FILTER (WHERE pc.code = 'NA') AS n_source_country_rows_na_code FROM tr LEFT JOIN pc ON pc.pmid = tr.PMID AND state <> 'Disappeared' GROUP BY 1) USING (focal_year)
LEFT JOIN (SELECT PYEAR AS focal_year, c.cat, count(DISTINCT (s, p, o)) AS n_source_exact_triples, count(DISTINCT (tr.PMID, s, p, o)) FILTER (WHERE pc.code IS NOT NULL) AS n_source_rows_with_country_in_category, count(DISTINCT (s, p, o, pc.code)) FILTER (WHERE pc.code IS NOT NULL) AS n_source_triple_country_rows
  FROM tr JOIN (VALUES ('New_Node', 'New_Node'), ('New_Combination', 'New_Combination'), ('New_Relation', 'New_Relation'), ('Repeated_Triple', 'Repeated_Triple'), ('New_Node', 'Pooled_New_Knowledge'), ('New_Combination', 'Pooled_New_Knowledge'), ('New_Relation', 'Pooled_New_Knowledge')) c(e, cat) ON c.e = edge_annotation
  LEFT JOIN pc ON pc.pmid = tr.PMID WHERE state <> 'Disappeared' GROUP BY 1, 2) k ON k.focal_year = y.focal_year AND k.cat = y.cat
JOIN (SELECT f.focal_year, count(u.PMID) AS n_future_rows_scanned, count(*) FILTER (WHERE u.PMID IN (SELECT pmid FROM pc)) AS n_future_rows_with_country,
  count(*) FILTER (WHERE u.PMID IN (SELECT pmid FROM pc) AND (f.focal_year, u.s, u.p, u.o) IN (SELECT (PYEAR, s, p, o) FROM tr WHERE state <> 'Disappeared' AND PMID IN (SELECT pmid FROM pc))) AS n_future_rows_matched_to_source_exact_triples
  FROM (SELECT DISTINCT PYEAR AS focal_year FROM tr) f LEFT JOIN ann u ON u.PYEAR BETWEEN f.focal_year + 1 AND f.focal_year + {W} GROUP BY 1) u ON u.focal_year = y.focal_year
JOIN (SELECT f.focal_year, count(pc.code) AS n_future_country_rows, count(*) FILTER (WHERE pc.code = 'NA') AS n_future_country_rows_na_code FROM (SELECT DISTINCT PYEAR AS focal_year FROM tr) f LEFT JOIN ann u ON u.PYEAR BETWEEN f.focal_year + 1 AND f.focal_year + {W} LEFT JOIN pc ON pc.pmid = u.PMID GROUP BY 1) v ON v.focal_year = y.focal_year
LEFT JOIN (SELECT focal_year, edge_annotation AS cat, count(*) AS n_country_edges, count(*) FILTER (WHERE is_domestic_adoption) AS n_domestic_country_edges, {", ".join(f"sum({w}) AS total_{w}, sum({w}) FILTER (WHERE is_domestic_adoption) AS domestic_{w}" for w in _WEIGHTS)} FROM cnet GROUP BY 1, 2) e ON e.focal_year = y.focal_year AND e.cat = y.cat""",
    "audit_accounting": "SELECT *, n_links = n_expected_links AND n_linked_pmids = n_pmids AND n_pmids = n_distinct_pmids AS passed FROM (SELECT count(*)::BIGINT AS n_links, count(DISTINCT pmid)::BIGINT AS n_linked_pmids FROM lnk), (SELECT sum(greatest(1, n_works))::BIGINT AS n_expected_links, count(*)::BIGINT AS n_pmids, count(DISTINCT pmid)::BIGINT AS n_distinct_pmids FROM pap)",
    "audit3_rows": "SELECT * FROM au3",
    "audit3_status_by_year": "SELECT analysis_year, match_status, count(*)::BIGINT AS n_rows, count(DISTINCT pmid)::BIGINT AS n_pmids, count(DISTINCT work_id)::BIGINT AS n_works FROM au3 GROUP BY 1, 2",
    "audit3_differences": " UNION ALL ".join(f"SELECT '{k}' AS comparison, analysis_year, delta_{k} AS year_difference, count(DISTINCT pmid)::BIGINT AS n_pmids FROM au3 WHERE delta_{k} IS NOT NULL{'' if k == 'semmed_analysis' else ' AND n_works_for_pmid = 1 AND n_pmids_for_work = 1'} GROUP BY ALL" for k in ("semmed_analysis", "openalex_semmed", "sciscinet_semmed", "sciscinet_openalex")),
    "paper_master": "SELECT * FROM mas",
    "missingness": "SELECT variable, (SELECT count(*) FROM mas)::BIGINT AS n_rows, n_missing::BIGINT AS n_missing FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM mas) ON COLUMNS(*) INTO NAME variable VALUE n_missing)",
    "master_exclusions": "SELECT * FROM excl UNION ALL SELECT pmid, pyear, 1, 'missing_in_second_source' FROM sel WHERE workid NOT IN (SELECT workid FROM sci)",
    "sample_flow": "SELECT (SELECT count(*) FROM pam)::BIGINT AS n_annotation_pmids, (SELECT count(*) FROM sel)::BIGINT AS n_one_to_one_pmids, (SELECT count(*) FROM excl)::BIGINT AS n_excluded_mapping, (SELECT count(*) FROM sel WHERE workid NOT IN (SELECT workid FROM sci))::BIGINT AS n_excluded_missing_source, (SELECT count(*) FROM sel WHERE workid IN (SELECT workid FROM sci))::BIGINT AS n_output_pmids",
    "master_by_year": f"SELECT pyear, count(*)::BIGINT AS n_pmids, {_n('year_match_semmed_openalex', 'n_openalex_year_equal')}, {_n('year_match_semmed_sciscinet', 'n_sciscinet_year_equal')}, {_n('has_adoption_metrics', 'n_adoption_rows')}, {_n('has_development_metrics', 'n_development_rows')}, {', '.join(f'count(sci_C{k})::BIGINT AS n_nonmissing_c{k}' for k in (3, 5, 10))} FROM mas GROUP BY 1",
    "shared_metric_conflicts": " UNION ALL ".join(f"SELECT '{a}' AS retained_source, '{b}' AS checked_source, '{c}' AS metric, count(*) FILTER (WHERE x.{c} IS DISTINCT FROM y.{c} AND coalesce(abs(x.{c} - y.{c}) > 1e-9, true))::BIGINT AS n_conflicts FROM {_MODS[a]} x JOIN {_MODS[b]} y USING (PMID)" for a, b, cs in _SHARED for c in cs),
    "overall_profile": " UNION ALL ".join(f"SELECT '{d}' AS dataset, {WIDE}, count(DISTINCT PREDICATE)::BIGINT AS n_unique_predicate, {_n('subject_cui_primary = object_cui_primary', 'n_self_loop_triples')} FROM {t}" for d, t in (("raw", "keyed"), ("filtered", "prep"))),
    "retention_by_year": _retention("PYEAR"),
    "retention_by_predicate": _retention("PREDICATE"),
    "outcome_consistency_report": _distinct_conflicts({"triple with several categories": ("tr", "PYEAR, s, p, o", "edge_annotation"), "triple with several outcomes": ("tr", "PYEAR, s, p, o", "seen"), "pair with several labels": ("tr", "PYEAR, a, b", "edge_annotation")}),
    "recompute_report": "SELECT unnest(['only stored', 'only fresh', 'n_triples differs', 'n_new_triples differs', 'share_new_triples differs', 'share_new_node differs']) AS rule, unnest([count(*) FILTER (WHERE b.PMID IS NULL), count(*) FILTER (WHERE a.PMID IS NULL), count(*) FILTER (WHERE a.n_triples <> b.n_triples), count(*) FILTER (WHERE a.n_new_triples <> b.n_new_triples), count(*) FILTER (WHERE abs(a.share_new_triples - b.share_new_triples) > 1e-9), count(*) FILTER (WHERE abs(a.share_new_node - b.share_new_node) > 1e-9)])::BIGINT AS n_violations FROM pam a FULL JOIN pnk b ON a.PMID = b.PMID",
    "combine_report": "SELECT 'year without rows' AS rule, count(*)::BIGINT AS n_violations FROM years WHERE y NOT IN (SELECT PYEAR FROM pam) UNION ALL SELECT 'repeated paper', count(*) - count(DISTINCT PMID) FROM pam UNION ALL SELECT 'paper in several years', count(*) FROM (SELECT PMID FROM pam GROUP BY 1 HAVING count(DISTINCT PYEAR) > 1)",
    "year_bounds_report": "WITH m AS (SELECT PYEAR, " + ", ".join(f"max({n}) AS max_{n}, sum({n}) AS sum_{n}" for n in ("n_unique_concepts", "n_unique_new_concepts", "n_unique_concept_pairs", "n_unique_new_combination_pairs", "n_triples")) + " FROM pnk GROUP BY 1) " + _rules("ynk0 JOIN m USING (PYEAR)", {f"{n} out of bounds": f"{n} < max_{n} OR {n} > sum_{n}" for n in ("n_unique_concepts", "n_unique_new_concepts", "n_unique_concept_pairs", "n_unique_new_combination_pairs", "n_triples")}),
    "link_summary": f"SELECT *, {_share('n_linked_papers', 'n_papers', 'share_linked_papers')} FROM (SELECT count(*)::BIGINT AS n_papers, count(m.PMID)::BIGINT AS n_linked_papers, count(DISTINCT m.PMID)::BIGINT AS n_linked_pmids FROM spap LEFT JOIN (SELECT work_id, min(pmid) AS PMID FROM maps GROUP BY 1 HAVING count(*) = 1) m ON m.work_id = {WORK.format('paperid')}), (SELECT count(*)::BIGINT AS n_mapped_pmids, {_n('k > 1', 'n_pmids_with_many_works')}, sum(k)::BIGINT AS n_mappings FROM (SELECT count(*) AS k FROM maps GROUP BY pmid)), (SELECT count(*)::BIGINT AS n_rejected_mappings FROM (SELECT DISTINCT trim(work_id) AS a, trim(pmid) AS b, {PMID.format('pmid')} AS p, {WORK.format('work_id')} AS w FROM wid) WHERE p IS NULL OR w IS NULL OR w IN (SELECT work_id FROM maps GROUP BY 1 HAVING count(*) > 1))",
    "metric_rule_report": "SELECT unnest(['invalid year', 'invalid paper', 'categories add up', 'new categories add up', 'adopted add up', 'reappeared add up', "
    + ", ".join(f"'{n} within {d}', '{s} is the ratio'" for s, n, d in ADOPTION_RATIOS) + ", " + ", ".join(f"'has_{k} is a flag'" for k in ADOPTION_FLAGS) + "]) AS rule, unnest([count(*) FILTER (WHERE PYEAR IS NULL), count(*) FILTER (WHERE PMID IS NULL), count(*) FILTER (WHERE n_new_node + n_new_combination + n_new_relation + n_repeated_triple <> n_triples), count(*) FILTER (WHERE n_new_node + n_new_combination + n_new_relation <> n_new_triples), count(*) FILTER (WHERE n_new_node_adopted + n_new_combination_adopted + n_new_relation_adopted <> n_new_triples_adopted), count(*) FILTER (WHERE n_new_triples_adopted + n_repeated_triple_continued <> n_triples_reappeared), "
    + ", ".join(f"count(*) FILTER (WHERE {n} NOT BETWEEN 0 AND {d}), count(*) FILTER (WHERE {s} IS DISTINCT FROM {n}::DOUBLE / nullif({d}, 0))" for s, n, d in ADOPTION_RATIOS) + ", " + ", ".join(f"count(*) FILTER (WHERE has_{k} <> (n_{k} > 0)::INT)" for k in ADOPTION_FLAGS) + "])::BIGINT AS n_violations FROM pad",
    "annotation_flag_report": _rules("ann", {"category follows the flags": "edge_annotation <> CASE WHEN NOT subject_seen OR NOT object_seen THEN 'New_Node' WHEN NOT pair_connected THEN 'New_Combination' WHEN NOT exact_edge_seen THEN 'New_Relation' ELSE 'Repeated_Triple' END", "new node flag": "has_new_node <> (NOT subject_seen OR NOT object_seen)", "connected pair with a new node": "pair_connected AND (NOT subject_seen OR NOT object_seen)", "exact edge without its pair": "exact_edge_seen AND NOT pair_connected", "reversed edge without its pair": "reversed_edge_seen AND NOT pair_connected", "same predicate reversed without reversed": "same_predicate_reversed_edge_seen AND NOT reversed_edge_seen", "self loop": "s = o", "pair in order": "a > b"}),
    "network_checks": _rules("edg", {"year gap out of the window": f"year_gap NOT BETWEEN 1 AND {W}", "weights don''t add up": "n_shared_new_node_triples + n_shared_new_combination_triples + n_shared_new_relation_triples <> n_shared_new_triples", "edge to itself": "adopter_pmid = focal_pmid"})
    + " UNION ALL SELECT 'repeated pair', count(*) - count(DISTINCT (adopter_pmid, focal_pmid)) FROM edg UNION ALL SELECT 'total weight differs from the profile', abs((SELECT coalesce(sum(n_shared_new_triples), 0) FROM edg) - (SELECT coalesce(sum(n_focal_pmids * n_future_pmids), 0) FROM nfo JOIN nfu USING (focal_year, s, p, o)))::BIGINT UNION ALL SELECT 'in-degree and adoption disagree', count(*) FROM pad WHERE (PMID IN (SELECT focal_pmid FROM edg)) <> (has_new_triples_adopted = 1) UNION ALL SELECT 'end of an edge isn''t a node', count(*) FROM edg WHERE focal_pmid NOT IN (SELECT PMID FROM pam) OR adopter_pmid NOT IN (SELECT PMID FROM pam) UNION ALL SELECT 'paper without a year on both sides', count(*) FROM edg WHERE focal_year IS NULL AND adopter_year IS NULL",
}


def _with(sql: str) -> str:
    """The query with the relations it needs, in the order of their definition."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf'(?<![\w.\'])"?{name}"?(?![\w\'.]*\()', text) and re.search(rf'\b(?:FROM|JOIN|IN \(SELECT .{{0,80}} FROM)\s+"?{name}\b|,\s*{name}\b(?=\s+\w)', text):
                need.add(name)
                todo.append(CTES[name])
    ctes = ", ".join(f'"{n}" AS MATERIALIZED ({CTES[n]})' for n in CTES if n in need)
    if not ctes:
        return sql
    return f"WITH {ctes}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes} {sql}"


def oracle_sql() -> dict[str, str]:
    return {name: _with(sql) for name, sql in QUERIES.items()}
