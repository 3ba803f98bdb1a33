"""Descriptive profiles of prepared triples: years, predicates, concepts, overlaps, duplicates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmaps import prior_sets, sizes, unions, yearly_bitmaps
from ..functions.ids import share, valid_cui
from ..sources.shared import written

S, P, O = "subject_cui_primary", "PREDICATE", "object_cui_primary"  # noqa: E741


def long_concepts(prepared: DataFrame) -> DataFrame:
    """Two rows for each triple, one for each end with its role and neighbour; one scan."""
    def end(role: str, other: str) -> Column:
        x, y = role.lower(), other.lower()
        return F.struct(F.lit(x).alias("role"), F.col(f"{x}_cui_primary").alias("concept"), F.col(f"{x}_name_primary").alias("name"), F.nullif(F.trim(f"{role}_SEMTYPE"), F.lit("")).alias("semtype"), F.col(f"{y}_cui_primary").alias("neighbour"))

    return prepared.select("PMID", "PYEAR", P, S, O, F.explode(F.array(end("SUBJECT", "OBJECT"), end("OBJECT", "SUBJECT"))).alias("e")).select("PMID", "PYEAR", P, S, O, "e.*")


WIDE = (
    "n_unique_pmid", "n_unique_subject_cui_primary", "n_unique_object_cui_primary", "n_unique_subject_name_primary", "n_unique_object_name_primary",
    "n_unique_exact_triple", "n_unique_directed_pair",
)
PREDICATES = ("n_unique_predicate",)


def _wide(rows: DataFrame, keys: list[str], more: tuple[str, ...] = (), loops: bool = False) -> DataFrame:
    """Rows and distinct values of many kinds for each group.

    A row is its triple, its paper and its two names first; concepts, predicates and pairs are
    values of distinct triples, names of either end (``n_unique_name_primary``) of distinct names.  Values are counted by
    kind, so that a distinct count is a count of rows; a kind that is distinct already is a number without its values.
    """
    none = F.lit(None).cast("string")
    cell = lambda kind, *v: F.struct(F.lit(kind).alias("kind"), F.struct(*[x.alias(f"v{i}") for i, x in enumerate((*v, none, none, none)[:3])]).alias("value"))
    known = lambda kind, *v: F.when(sum((x.isNull().cast("int") for x in v), F.lit(0)) == 0, cell(kind, *v))
    names = {f"n_unique_{x}_name_primary": f"{x}_name_primary" for x in ("subject", "object")}
    first = [cell("triple", F.col(S), F.col(P), F.col(O)), known("n_unique_pmid", F.col("PMID")), *[known(k, F.col(c)) for k, c in names.items()]]
    seen = rows.select(*keys, F.explode(F.array_compact(F.array(*first))).alias("x")).select(*keys, "x.*").distinct()

    kind, s, p, o = F.col("kind"), F.col("value.v0"), F.col("value.v1"), F.col("value.v2")
    of_triple = {"n_unique_subject_cui_primary": [(s,)], "n_unique_object_cui_primary": [(o,)], "n_unique_directed_pair": [(s, o)], "n_unique_pair_connection": [(F.least(s, o), F.greatest(s, o))], "n_unique_cui_primary": [(s,), (o,)]} | {k: [(p,)] for k in more}
    whole = F.when(s.isNotNull() & p.isNotNull() & o.isNotNull(), cell("n_unique_exact_triple"))
    triple = F.array(whole, *[known(k, *v) for k, ways in of_triple.items() for v in ways])
    name = F.array(*[F.when(kind == k, cell(k)) for k in names], cell("n_unique_name_primary", s))
    values = F.when(kind == "triple", triple).when(kind == "n_unique_pmid", F.array(cell("n_unique_pmid"))).otherwise(name)
    per = seen.select(*keys, F.explode(F.array_compact(values)).alias("x")).select(*keys, "x.*").groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"))
    kinds = [*WIDE, *more, "n_unique_pair_connection", "n_unique_cui_primary", "n_unique_name_primary"]
    total = lambda k: F.count_if(kind == k) if k in of_triple or k == "n_unique_name_primary" else F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0))
    counts = per.groupBy(*keys).agg(*[total(k).alias(k) for k in kinds])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_pmid_unique_triples"), *([F.count_if(F.col(S) == F.col(O)).alias("n_self_loop_triples")] if loops else []))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return sizes.join(counts.withColumnsRenamed({k: f"__{k}" for k in keys}), on, "left").drop(*[f"__{k}" for k in keys]).withColumns({k: F.coalesce(k, F.lit(0)) for k in kinds})


def yearly_profile(prepared: DataFrame) -> DataFrame:
    """A row for each year: distinct papers, predicates, concepts, names, triples, pairs, self loops, shares of all."""
    total = prepared.agg(F.count("*").alias("t"), F.count_distinct("PMID").alias("m"))
    out = _wide(prepared, ["PYEAR"], PREDICATES, loops=True).crossJoin(total)  # one row
    return out.withColumns({"share_pmid_unique_triples": share(F.col("n_pmid_unique_triples"), F.col("t")), "share_unique_pmid": share(F.col("n_unique_pmid"), F.col("m")), "share_self_loop_triples": share(F.col("n_self_loop_triples"), F.col("n_pmid_unique_triples"))}).drop("t", "m")


def predicate_year_profile(prepared: DataFrame) -> DataFrame:
    """As :func:`yearly_profile` for each year and predicate, with shares and dense ranks."""
    wide = _wide(prepared, ["PYEAR", P])
    sizes = prepared.groupBy(P).agg(F.count("*").alias("n"))
    # predicates are a fixed vocabulary: its ranking is one small table
    overall = sizes.withColumn("predicate_rank_overall_by_triples", F.dense_rank().over(Window.orderBy(F.desc("n")))).drop("n")
    year = Window.partitionBy("PYEAR")
    n = F.col("n_pmid_unique_triples")
    total = prepared.agg(F.count("*").alias("t"))
    out = wide.withColumns({"share_of_year_pmid_unique_triples": share(n, F.sum(n).over(year)), "predicate_rank_within_year_by_triples": F.dense_rank().over(year.orderBy(F.desc("n_pmid_unique_triples")))})
    return out.join(overall, P).crossJoin(total).withColumn("share_of_all_pmid_unique_triples", share(n, F.col("t"))).drop("t")  # one row


OVERLAPS = {"cui_primary": (1, 3, 5), "pair_connection": (5,), "exact_triple": (5,)}


def _overlaps(prepared: DataFrame, kinds: tuple[str, ...], windows: tuple[int, ...]) -> DataFrame:
    """``y, kind, size, o1, u1, ...``: how many keys a year has, how many of them
    the ``w`` years before have (``o``), and how many those years have (``u``).

    The years of each key meet once for all kinds and windows.  A year of a key
    counts for the years after it, up to the key's next year or the largest
    window, so each key counts once in a union.
    """
    none = F.lit(None).cast("string")
    key = lambda kind, *k: F.struct(F.lit(kind).alias("kind"), *[x.alias(f"k{i}") for i, x in enumerate((*k, none, none)[:3])])
    keys = {
        "cui_primary": [key("cui_primary", F.col(S)), key("cui_primary", F.col(O))],
        "pair_connection": [key("pair_connection", F.least(S, O), F.greatest(S, O))], "exact_triple": [key("exact_triple", F.col(S), F.col(P), F.col(O))],
    }
    most = max(windows)
    of_key = prepared.select(F.explode(F.array(*[x for k in kinds for x in keys[k]])).alias("k"), F.col("PYEAR").cast("int").alias("y")).groupBy("k").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    at = lambda i: F.get("ys", i)
    own = F.transform("ys", lambda y, i: F.struct(y.alias("y"), F.lit(True).alias("own"), (y - F.when(i > 0, at(i - 1))).alias("gap")))
    until = lambda y, i: F.least(y + most, F.coalesce(at(i + 1), y + most))
    later = F.flatten(F.transform("ys", lambda y, i: F.transform(F.sequence(y + 1, until(y, i)), lambda z: F.struct(z.alias("y"), F.lit(False).alias("own"), (z - y).alias("gap")))))
    seen = of_key.select("k.kind", F.explode(F.concat(own, later)).alias("e")).select("kind", "e.*")
    return seen.groupBy("y", "kind").agg(F.count_if("own").alias("size"), *[F.count_if((F.col("own") == mine) & (F.col("gap") <= w)).alias(f"{n}{w}") for w in windows for n, mine in (("o", True), ("u", False))]).filter("size > 0 or kind = 'cui_primary'")


def prior_overlap(prepared: DataFrame) -> DataFrame:
    """For each year and prior windows of 1, 3 and 5 years: size of the union, overlap, share, new; pairs and triples for 5."""
    per = _overlaps(prepared, tuple(OVERLAPS), (1, 3, 5))
    cell = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    flat = per.groupBy("y").agg(*[cell(k, c).alias(f"{c}_{k}") for k, ws in OVERLAPS.items() for c in ("size", *[f"{n}{w}" for w in ws for n in "ou"])]).filter("size_cui_primary > 0")
    out = flat.crossJoin(flat.agg(F.collect_set("y").alias("known")))  # one row
    cols = [F.col("y").alias("PYEAR")]
    for k, ws in OVERLAPS.items():
        for w in ws:
            size, o, u = F.col(f"size_{k}"), F.col(f"o{w}_{k}"), F.col(f"u{w}_{k}")
            cols += [u.alias(f"n_prior_{w}y_{k}"), o.alias(f"n_overlap_prior_{w}y_{k}"), share(o, size).alias(f"share_focal_{k.removesuffix('_primary')}_seen_prior_{w}y")]
            if k == "cui_primary":
                cols += [(size - o).alias(f"n_new_cui_vs_prior_{w}y"), (F.size(F.array_intersect(F.sequence(F.col("y") - w, F.col("y") - 1), "known")) == w).alias(f"has_full_prior_{w}y_window")]
    return out.select(*cols)


def prior_jaccard(prepared: DataFrame) -> DataFrame:
    """Jaccard similarity of each year's concepts with the union of the 1, 3 and 5 years before."""
    per = _overlaps(prepared, ("cui_primary",), (1, 3, 5)).filter("size > 0")
    return per.select(F.col("y").alias("PYEAR"), F.col("size").alias("n_concepts"), *[share(F.col(f"o{w}"), F.nullif(F.col("size") + F.col(f"u{w}") - F.col(f"o{w}"), F.lit(0))).alias(f"jaccard_prior_{w}y") for w in (1, 3, 5)])


def prior_jaccard_by_bitmaps(prepared: DataFrame) -> DataFrame:
    """As :func:`prior_jaccard`, from yearly bitmaps that can be kept and merged as years come in."""
    ends = prepared.select(F.explode(F.array(S, O)).alias("concept"), "PYEAR")
    per = prior_sets(yearly_bitmaps(ends, ["concept"], "PYEAR"), (1, 3, 5))
    jaccard = share(F.col("overlap"), F.nullif(F.col("size") + F.col("before") - F.col("overlap"), F.lit(0)))
    return per.groupBy(F.col("y").alias("PYEAR")).agg(F.max("size").alias("n_concepts"), *[F.max(F.when(F.col("w") == w, jaccard)).alias(f"jaccard_prior_{w}y") for w in (1, 3, 5)])


def distinct_since(prepared: DataFrame) -> DataFrame:
    """For each year, how many distinct concepts, triples and papers there are up to it, as ORs of yearly bitmaps."""
    ends = prepared.select(F.explode(F.array(S, O)).alias("concept"), "PYEAR")
    out = None
    for name, rows, keys in (("concepts", ends, ["concept"]), ("triples", prepared, [S, P, O]), ("papers", prepared, ["PMID"])):
        bits = written(yearly_bitmaps(rows, keys, "PYEAR"))
        years = bits.select("y").distinct()
        spans = years.select(F.col("y").alias("name")).join(F.broadcast(years), F.col("y") <= F.col("name"))  # years, a few
        part = sizes(unions(bits, spans), "name").select(F.col("name").alias("PYEAR"), F.col("n").alias(f"n_{name}_since"))
        out = part if out is None else out.join(part, "PYEAR", "full")
    return out


def concept_profile(prepared: DataFrame) -> DataFrame:
    """26 columns for each concept of prepared triples, of which a paper has each once.

    Rows are counted by concept, kind of value and value first; a distinct
    count is then a count of those rows.  Of papers, predicates and neighbours only
    numbers go on to a concept's row; texts and years go on by themselves.
    """
    rows = long_concepts(prepared)
    sub = F.col("role") == "subject"
    other = F.col("neighbour") != F.col("concept")
    values = {"row": F.lit(""), "pmid": F.col("PMID"), "pyear": F.col("PYEAR"), "predicate": F.col(P), "neighbour": F.when(other, F.col("neighbour")), "name": F.col("name"), "semtype": F.col("semtype")}
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])
    # a triple of a concept with itself has two rows: its second isn't a triple more
    counted = rows.select("concept", sub.alias("sub"), (sub | other).alias("first"), F.explode(cells).alias("x")).filter("x.value is not null").groupBy("concept", "x.kind", "x.value").agg(F.count_if("sub").alias("ns"), F.count_if(~F.col("sub")).alias("no"), F.count_if("first").alias("n1"))
    text = F.when(F.col("kind").isin("name", "semtype", "pyear"), F.col("value"))
    summed = counted.groupBy("concept", "kind", text.alias("value")).agg(F.count("*").alias("k"), F.count_if(F.col("ns") > 0).alias("ks"), F.count_if(F.col("no") > 0).alias("ko"), F.sum("ns").alias("ns"), F.sum("no").alias("no"), F.sum("n1").alias("n1"))
    kind, value, n = F.col("kind"), F.col("value"), F.col("ns") + F.col("no")
    of = lambda k, c="k": F.coalesce(F.sum(F.when(kind == k, F.col(c))), F.lit(0))
    year = F.when(kind == "pyear", value).cast("int")
    modal = lambda k: F.min_by(value, F.when(kind == k, F.struct((-n).alias("m"), value.alias("v"))))
    texts = [x for k in ("name", "semtype") for x in (modal(k).alias(f"primary_{k}"), F.nullif(of(k), F.lit(0)).alias(f"n_distinct_primary_{k}"), F.array_sort(F.collect_list(F.when(kind == k, value))).alias(f"__{k}s"))]
    out = summed.groupBy("concept").agg(
        of("row", "n1").alias("n_pmid_unique_triples"), of("pmid").alias("n_unique_pmid"), of("pyear").alias("n_unique_pyear"), F.min(year).alias("first_seen_pyear"), F.max(year).alias("last_seen_pyear"),
        F.size(F.collect_set(year)).cast("bigint").alias("n_active_pyear"), of("predicate").alias("n_unique_predicate"), of("row", "ns").alias("n_subject_triples"), of("row", "no").alias("n_object_triples"),
        of("pmid", "ks").alias("n_unique_pmid_as_subject"), of("pmid", "ko").alias("n_unique_pmid_as_object"), of("predicate", "ks").alias("n_unique_predicate_as_subject"), of("predicate", "ko").alias("n_unique_predicate_as_object"),
        of("neighbour").alias("n_unique_neighbor_cui"), of("neighbour", "ks").alias("n_unique_out_neighbor_cui"), of("neighbour", "ko").alias("n_unique_in_neighbor_cui"), *texts,
    )
    both = F.col("n_subject_triples") + F.col("n_object_triples")
    out = out.withColumns({f"all_primary_{k}s": F.when(F.size(f"__{k}s") > 0, F.array_join(f"__{k}s", "|")) for k in ("name", "semtype")}).drop("__names", "__semtypes")
    return out.withColumns({"active_year_span": F.col("last_seen_pyear") - F.col("first_seen_pyear") + 1, "share_as_subject": share(F.col("n_subject_triples"), both), "share_as_object": share(F.col("n_object_triples"), both)}).withColumnRenamed("concept", "primary_cui")


def duplicate_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups, repeated ones, rows in them, excess rows, largest group."""
    n, more = F.col("n"), F.col("n") > 1
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(more).alias("n_duplicate_groups"), F.coalesce(F.sum(F.when(more, n)), F.lit(0)).alias("n_rows_in_duplicate_groups"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("n_excess_rows"), F.max(n).alias("max_group_size"),
    )
    return out.withColumn("share_excess_rows", share(F.col("n_excess_rows"), F.col("n_rows")))


def group_size_distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups")).withColumn("n_rows", F.col("group_size") * F.col("n_groups"))


RAW_KEY, PRIMARY_KEY = ["PMID", "SUBJECT_CUI", P, "OBJECT_CUI"], ["PMID", S, P, O]


def _repeated(rows: DataFrame, keys: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those alone with each of their ``keys``, and those of which a hash of a key occurs again.

    Rows that share a key share its hash; a few others may by chance, so keys of the second part are still to be
    grouped.  All rows are grouped by numbers only, however long their keys are.
    """
    rows = written(rows)
    hashes = [F.xxhash64(F.lit(i), *k) for i, k in enumerate(keys)]
    again = written(rows.select(F.explode(F.array(*hashes)).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    marked = rows
    for i, h in enumerate(hashes):
        marked = marked.withColumn("__h", h).join(again.select(F.col("h").alias("__h"), F.lit(True).alias(f"__{i}")), "__h", "left").drop("__h")
    some = F.coalesce(*[F.col(f"__{i}") for i in range(len(keys))], F.lit(False))
    return marked.filter(~some).select(*rows.columns), marked.filter(some).select(*rows.columns)


def collisions(rows: DataFrame) -> DataFrame:
    """Primary keys that hide more than one raw key, with how many; only rows whose primary key may occur again are looked at."""
    several = _repeated(rows.select(*PRIMARY_KEY, "SUBJECT_CUI", "OBJECT_CUI"), [PRIMARY_KEY])[1]
    variants = several.groupBy(*PRIMARY_KEY, "SUBJECT_CUI", "OBJECT_CUI").agg(F.count("*").alias("n"))
    return variants.groupBy(*PRIMARY_KEY).agg(F.count("*").alias("n_raw_variants"), F.sum("n").alias("n_rows")).filter("n_raw_variants > 1")


def collision_summary(rows: DataFrame) -> DataFrame:
    return collisions(rows).agg(F.count("*").alias("n_collision_groups"), F.coalesce(F.sum("n_raw_variants"), F.lit(0)).alias("n_raw_variants"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.max("n_raw_variants").alias("max_raw_variants"))


def collision_examples(rows: DataFrame, top: int = 100) -> DataFrame:
    """The ``top`` groups with most variants (ties: most rows, then the key), a report."""
    return collisions(rows).orderBy(F.desc("n_raw_variants"), F.desc("n_rows"), *PRIMARY_KEY).limit(top)


def duplicate_scope_summary(rows: DataFrame) -> DataFrame:
    """Duplicates within papers by year, scope (all, without self loops) and kind of key.

    A row that is alone with its keys is a group of each kind, and is counted by year; only
    the others become a row for each scope and kind.
    """
    loop = F.col(S) == F.col(O)
    kinds = {"raw": ("SUBJECT_CUI", "OBJECT_CUI", F.lit("")), "primary": (S, O, F.lit("")), "primary_in_sentence": (S, O, F.col("SENTENCE_ID"))}
    keys = F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(a).alias("ks"), F.col(b).alias("ko"), c.alias("extra")) for k, (a, b, c) in kinds.items()])
    scopes = lambda loop: F.explode(F.when(loop, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("non_self_loop"))))
    bad = ~(valid_cui(F.col(S)) & valid_cui(F.col(O)))
    differs = (F.col(S) != F.col("SUBJECT_CUI")) | (F.col(O) != F.col("OBJECT_CUI"))
    alone, several = _repeated(rows.select("PYEAR", "PMID", "SENTENCE_ID", P, S, O, "SUBJECT_CUI", "OBJECT_CUI"), [["PYEAR", *RAW_KEY], ["PYEAR", *PRIMARY_KEY]])
    per = several.withColumn("scope", scopes(loop)).withColumn("k", F.explode(keys)).groupBy("PYEAR", "scope", "k.key_type", "PMID", "k.ks", P, "k.ko", "k.extra").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(differs).alias("differs"))
    single = alone.groupBy("PYEAR", loop.alias("loop")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(differs).alias("differs"))
    single = single.withColumn("scope", scopes(F.col("loop"))).withColumn("key_type", F.explode(F.array(*map(F.lit, kinds))))
    zero = F.lit(0).cast("bigint")
    parts = single.select("PYEAR", "scope", "key_type", F.col("n").alias("n_rows"), F.col("n").alias("n_groups"), zero.alias("n_duplicate_groups"), zero.alias("n_rows_in_duplicate_groups"), zero.alias("n_excess_rows"), F.lit(1).cast("bigint").alias("max_group_size"), F.col("bad").alias("n_rows_invalid_cui"), F.col("differs").alias("n_rows_primary_differs"))
    both = parts.unionByName(_rolled(per.groupBy("PYEAR", "scope", "key_type")).drop("share_excess_rows"))
    out = both.groupBy("PYEAR", "scope", "key_type").agg(*[(F.max if c == "max_group_size" else F.sum)(c).alias(c) for c in both.columns[3:]])
    return out.withColumn("share_excess_rows", share(F.col("n_excess_rows"), F.col("n_rows")))


def _rolled(groups) -> DataFrame:
    n, more = F.col("n"), F.col("n") > 1
    out = groups.agg(
        F.sum(n).alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(more).alias("n_duplicate_groups"), F.coalesce(F.sum(F.when(more, n)), F.lit(0)).alias("n_rows_in_duplicate_groups"), F.sum(n - 1).alias("n_excess_rows"), F.max(n).alias("max_group_size"),
        F.sum("bad").alias("n_rows_invalid_cui"), F.sum("differs").alias("n_rows_primary_differs"),
    )
    return out.withColumn("share_excess_rows", share(F.col("n_excess_rows"), F.col("n_rows")))


def duplicate_overall_rollup(summary: DataFrame) -> DataFrame:
    """Years and, by a roll-up, all years together, for each scope and kind of key."""
    sums = ("n_rows", "n_groups", "n_duplicate_groups", "n_rows_in_duplicate_groups", "n_excess_rows")
    rolled = summary.rollup("scope", "key_type", "PYEAR").agg(*[F.sum(c).alias(c) for c in sums], F.max("max_group_size").alias("max_group_size"), F.grouping_id().alias("g"))
    out = rolled.filter("g <= 1").withColumn("PYEAR", F.when(F.col("g") == 1, "ALL").otherwise(F.col("PYEAR"))).drop("g")
    return out.withColumn("share_excess_rows", share(F.col("n_excess_rows"), F.col("n_rows")))


def _overall(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _wide(rows, keys, PREDICATES, loops=True).drop("n_unique_cui_primary", "n_unique_name_primary")


def overall_profile(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """The same counts over the raw and the filtered table, a row each."""
    both = raw.withColumn("dataset", F.lit("raw")).unionByName(kept.withColumn("dataset", F.lit("filtered")))
    return _overall(both, ["dataset"])


def retention(raw: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``, how much of the raw table the filtered one keeps."""
    names = ("n_pmid_unique_triples", "n_unique_pmid", "n_unique_predicate", "n_unique_exact_triple", "n_unique_pair_connection")
    a, b = _overall(raw, [by]), _overall(kept, [by])
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = a.select(by, *[F.col(n).alias(f"{n}_raw") for n in names]).join(b.select(by, *[F.col(n).alias(f"{n}_filtered") for n in names]), by, "full")
    met = met.withColumns({c: zero(c) for c in met.columns if c != by})
    return met.withColumns({f"retention_{n.removeprefix('n_')}": share(F.col(f"{n}_filtered"), F.col(f"{n}_raw")) for n in names})
