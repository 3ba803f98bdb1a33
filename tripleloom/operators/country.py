"""Countries: names, counting, and the network of adoption between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import country_code, is_missing, list_items, listed, pmid_tail, share
from ..sources.shared import written
from .annotate import NEW

POOLED = "Pooled_New_Knowledge"
TRIPLE = ("s", "p", "o")


def country_names(paper_country: DataFrame) -> DataFrame:
    """``code, name``: the least non-blank name of each code."""
    good = paper_country.filter(~is_missing(F.col("code")))
    return good.groupBy("code").agg(F.coalesce(F.min(F.when(~is_missing(F.col("name")), F.col("name"))), F.first("code")).alias("name"))


def pmid_country(rows: DataFrame) -> DataFrame:
    """Full counting: each paper once for each of its countries.

    ``rows(pmid, work_id, author_id, institution_id, country_code, country_name)``.
    """
    good = rows.filter(~is_missing(F.col("pmid")) & ~is_missing(F.col("country_code")))
    return good.groupBy("pmid", F.col("country_code").alias("institution_country_code")).agg(
        listed("country_name", "; ").alias("institution_country"), F.lit(1).cast("bigint").alias("pmid_country_weight"),
        F.count_distinct("work_id").alias("n_work_ids_for_pmid_country"), F.count_distinct("author_id").alias("n_authors_for_pmid_country"),
        F.count_distinct("institution_id").alias("n_institutions_for_pmid_country"), F.count("*").alias("n_authorship_institution_rows_for_pmid_country"),
    )


def pmid_country_lists(counted: DataFrame) -> DataFrame:
    """Sorted codes and names of each paper as ``;``-lists."""
    return counted.groupBy("pmid").agg(
        listed("institution_country_code", ";").alias("country_codes"),
        listed("institution_country", ";").alias("countries"), F.count_distinct("institution_country_code").alias("n_countries"),
    )


def explode_country_list(lists: DataFrame) -> DataFrame:
    return lists.select("pmid", F.explode(list_items(F.col("country_codes"))).alias("code"))


def rank_first_lookup(institutions: DataFrame) -> DataFrame:
    """One row for each institution: with a code first, then the latest version, then by name."""
    code = country_code(F.col("country_code"), F.col("geo_code"), F.col("country_name"))
    kept = institutions.filter(~is_missing(F.col("institution_id"))).withColumn("code", code)
    rank = F.struct(F.col("code").isNull().alias("a"), (-F.col("version")).alias("b"), F.col("display_name").alias("c"))
    best = kept.groupBy("institution_id").agg(F.min_by(F.struct("display_name", "code", "country_name"), rank).alias("x"))
    return best.select("institution_id", "x.display_name", F.col("x.code").alias("country_code"), F.col("x.country_name").alias("country_name"))


def authorship_institution(authorships: DataFrame, institutions: DataFrame, works: DataFrame) -> DataFrame:
    """Authorships of works that have a PMID, with their institution if it is known."""
    tail = pmid_tail(F.trim("pmid"))
    linked = works.withColumn("pmid", tail).filter(F.col("pmid").isNotNull()).groupBy(F.regexp_extract("work_id", "(W[0-9]+)", 1).alias("work_id")).agg(F.min("pmid").alias("pmid"))
    good = authorships.filter(~is_missing(F.col("author_id")))
    return good.join(linked, "work_id").join(rank_first_lookup(institutions), "institution_id", "left").select("pmid", "work_id", "author_id", "author_position", "institution_id", "display_name", "country_code", "country_name")


def authorship_coverage(rows: DataFrame) -> DataFrame:
    """One row of counts and shares of what is known."""
    out = rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("pmid").alias("n_pmids"), F.count_distinct("work_id").alias("n_works"), F.count_distinct("author_id").alias("n_authors"), F.count_distinct("institution_id").alias("n_institutions"),
        F.count("institution_id").alias("n_rows_with_institution"), F.count("display_name").alias("n_rows_matched"), F.count("country_code").alias("n_rows_with_country"),
    )
    return out.withColumns({f"share_{x}": share(F.col(f"n_{x}"), F.col("n_rows")) for x in ("rows_with_institution", "rows_matched", "rows_with_country")})


def first_last_authors(rows: DataFrame) -> DataFrame:
    """Rows of first and last authors, with how many countries that author has on that work."""
    per = rows.groupBy("work_id", "author_id").agg(F.count_distinct("country_code").alias("n_countries"))
    return rows.filter(F.col("author_position").isin("first", "last")).join(per, ["work_id", "author_id"]).select("pmid", "work_id", "author_id", "author_position", "institution_id", "country_code", "n_countries")


def attach_country_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Each row with its paper's country lists; no row is lost or repeated.  A
    paper with several lists is an error when the result is read."""
    rest = [c for c in lists.columns if c != "pmid"]
    once = lists.groupBy(F.col("pmid").alias("PMID")).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__x"))
    gate = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several country lists of paper "), F.col("PMID")))).otherwise(F.col("__x"))
    return rows.join(once.select("PMID", gate.alias("__x")), "PMID", "left").select(*rows.columns, *[F.col(f"__x.{c}").alias(c) for c in rest])


def country_match_summary(attached: DataFrame) -> DataFrame:
    found = F.col("n_countries").isNotNull()
    papers = attached.select("PYEAR", "PMID", "n_countries").distinct().groupBy("PYEAR").agg(F.count("*").alias("n_pmids"), F.count("n_countries").alias("n_matched_pmids"), F.avg("n_countries").alias("mean_countries"), F.max("n_countries").alias("max_countries"))
    out = attached.groupBy("PYEAR").agg(F.count("*").alias("n_rows"), F.count_if(found).alias("n_matched_rows")).join(papers, "PYEAR")
    return out.withColumns({"share_matched_rows": share(F.col("n_matched_rows"), F.col("n_rows")), "share_matched_pmids": share(F.col("n_matched_pmids"), F.col("n_pmids"))})


def _words(n: int) -> list:
    """The columns ``b0, b1, ...`` of a set of numbers below ``n``, 63 to a column, as aggregates of a column ``place``."""
    return [F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / 63) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 63).cast("int")))), F.lit(0).cast("bigint")).alias(f"b{k}") for k in range(-(-n // 63))]


def _places(column: str, first: int, end: int):
    """The numbers whose bits are set in a word that begins with ``first``."""
    return F.filter(F.sequence(F.lit(first), F.lit(end - 1)), lambda p: F.getbit(F.col(column), p - first) == 1)


def _every_place(bits: list[str], n: int):
    return F.flatten(F.array(*[_places(b, 63 * k, min(n, 63 * k + 63)) for k, b in enumerate(bits)]))


def _numbered(paper_country: DataFrame) -> DataFrame:
    """``code, name, place``: countries are a fixed vocabulary, numbering them is one small table."""
    return written(country_names(paper_country).withColumn("place", (F.row_number().over(Window.orderBy("code")) - 1).cast("int")))


def _sets(paper_country: DataFrame, codes: DataFrame, n: int) -> DataFrame:
    """``PMID, b0, ...``: the countries of each paper as a set of bits."""
    return paper_country.join(F.broadcast(codes.select("code", "place")), "code").groupBy(F.col("pmid").alias("PMID")).agg(*_words(n))


def _with_pooled(kind: str = "edge_annotation"):
    """The categories that a row counts for: its own, and the pooled one if it is new."""
    return F.when(F.col(kind).isin(*NEW), F.array(kind, F.lit(POOLED))).otherwise(F.array(kind))


def _reused(transitions: DataFrame) -> DataFrame:
    return transitions.filter(F.col("future_five_year_transition").isin("Adopted", "Continued"))


SCOPE = ("focal_year", "edge_annotation", "future_five_year_transition")


def _papers_by_pair(rows: DataFrame, mine: list[str], others: list[str], n: int, names: tuple[str, str], count: str) -> DataFrame:
    """Distinct papers of each scope with a country of the set ``mine``, their own, and one of ``others``, as places.

    The sets that a paper meets become one; its bits are counted eight at a time, so a
    paper is a few rows for each of its own countries, however many others it meets.
    """
    once = rows.groupBy(*SCOPE, "PMID", *mine).agg(*[F.bit_or(c).alias(c) for c in others])
    pieces = [F.struct(F.lit(63 * k + at).alias("first"), F.call_function("shiftright", F.col(c), F.lit(at)).bitwiseAND(F.lit(255)).cast("int").alias("piece")) for k, c in enumerate(others) for at in range(0, min(63, n - 63 * k), 8)]
    own = once.select(*SCOPE, F.explode(_every_place(mine, n)).alias(names[0]), F.filter(F.array(*pieces), lambda x: x["piece"] != 0).alias("x"))
    counts = own.select(*SCOPE, names[0], F.explode("x").alias("x")).groupBy(*SCOPE, names[0], "x.first", "x.piece").agg(F.count("*").alias("n"))
    return counts.select(*SCOPE, names[0], F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda p: F.getbit(F.col("piece"), p) == 1), lambda p: p + F.col("first"))).alias(names[1]), "n").groupBy(*SCOPE, *names).agg(F.sum("n").alias(count))


def country_network(transitions: DataFrame, annotated: DataFrame, paper_country: DataFrame, w: int = 5) -> DataFrame:
    """Adopter country to source country for each focal year and category (12 columns).

    Countries are sets of bits that travel with their papers.  Papers are counted per triple and
    country before triples meet, so a frequent triple never expands to pairs of papers.
    A distinct paper of an edge meets one set for each of its triples, the countries on the
    other side, so it doesn't expand to those countries either.
    """
    codes = _numbered(paper_country)
    n = max(1, codes.count())
    bits = [f"b{k}" for k in range(-(-n // 63))]
    others = [f"o{b}" for b in bits]
    sets = written(_sets(paper_country, codes, n))
    at, match = "place", ["focal_year", *TRIPLE]
    reused = _reused(transitions).select(F.col("PYEAR").alias("focal_year"), F.explode(_with_pooled()).alias("edge_annotation"), "future_five_year_transition", *TRIPLE, "PMID")
    left = written(reused.join(sets, "PMID").distinct())
    focal = left.select("focal_year").distinct()  # years, a few
    later = annotated.select(*TRIPLE, "PMID", F.explode(F.sequence(F.col("PYEAR") - w, F.col("PYEAR") - 1)).alias("focal_year")).join(F.broadcast(focal), "focal_year", "left_semi")
    right = written(later.join(sets, "PMID").distinct(), sets)

    def cells(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
        """Papers of each key and country; rows meet by triple before they become countries."""
        return rows.select(*keys, *bits).repartition(*TRIPLE).select(*keys, F.explode(_every_place(bits, n)).alias(at)).groupBy(*keys, at).agg(F.count("*").alias(count))

    source = written(cells(left, [*SCOPE, *TRIPLE], "n_source"))
    future = written(cells(right.join(source.select(*match).distinct(), match, "left_semi"), match, "n_future"))
    adopter_of, source_of = source.withColumnRenamed(at, "source_place"), future.withColumnRenamed(at, "adopter_place")
    edge = [*SCOPE, "adopter_place", "source_place"]
    core = adopter_of.join(source_of, match).groupBy(*edge).agg(F.count("*").alias("weight_unique_exact_triples"), F.sum(F.col("n_source") * F.col("n_future")).alias("weight_source_pmid_x_future_pmid"))
    met = lambda counted, keys: counted.groupBy(*keys).agg(*_words(n)).withColumnsRenamed(dict(zip(bits, others, strict=True)))
    by_source = _papers_by_pair(left.join(met(future, match), match), bits, others, n, ("source_place", "adopter_place"), "weight_unique_source_pmids")
    by_future = _papers_by_pair(right.join(met(source, [*SCOPE, *TRIPLE]), match), bits, others, n, ("adopter_place", "source_place"), "weight_unique_future_pmids")
    out = core.join(by_source, edge).join(by_future, edge)
    for side in ("adopter", "source"):
        out = out.join(F.broadcast(codes.select(F.col("place").alias(f"{side}_place"), F.col("code").alias(f"{side}_country_code"), F.col("name").alias(f"{side}_country"))), f"{side}_place")
    weights = ("weight_unique_exact_triples", "weight_source_pmid_x_future_pmid", "weight_unique_source_pmids", "weight_unique_future_pmids")
    return out.select("source_country_code", "adopter_country_code", *SCOPE, *weights, "adopter_country", "source_country", (F.col("adopter_country_code") == F.col("source_country_code")).alias("is_domestic_adoption"))


def country_network_summary(network: DataFrame) -> DataFrame:
    """For each year and category: edges, domestic ones, total weights and shares."""
    weights = [c for c in network.columns if c.startswith("weight_")]
    home = F.col("is_domestic_adoption")
    out = network.groupBy("focal_year", "edge_annotation").agg(
        F.count("*").alias("n_edges"), F.count_if(home).alias("n_domestic_edges"), F.count_distinct("adopter_country_code").alias("n_adopter_countries"), F.count_distinct("source_country_code").alias("n_source_countries"),
        *[F.sum(c).alias(f"total_{c}") for c in weights], *[F.coalesce(F.sum(F.when(home, F.col(c))), F.lit(0)).alias(f"domestic_{c}") for c in weights],
    )
    return out.withColumns({"share_domestic_edges": share(F.col("n_domestic_edges"), F.col("n_edges"))} | {f"share_domestic_{c}": share(F.col(f"domestic_{c}"), F.col(f"total_{c}")) for c in weights})


def country_network_coverage(transitions: DataFrame, annotated: DataFrame, paper_country: DataFrame, network: DataFrame, w: int = 5) -> DataFrame:
    """For each focal year and category, absent ones too: how many reused rows and later rows have a country, what matched, and the network's size and weights.

    Rows are counted by year first; a focal year's later rows are sums over the years of its
    window, and a later row is matched if an earlier year of the window reused its triple, which the
    last such year tells for each focal year at once.
    """
    codes = _numbered(paper_country)
    n = max(1, codes.count())
    bits = [f"b{k}" for k in range(-(-n // 63))]
    na = codes.filter("code = 'NA'").select("place").first()  # one row at most
    size = lambda: sum(F.bit_count(F.coalesce(b, F.lit(0))).cast("long") for b in bits)
    is_na = F.lit(0).cast("long") if na is None else F.getbit(F.coalesce(bits[na["place"] // 63], F.lit(0)), F.lit(na["place"] % 63)).cast("long")
    sets = written(_sets(paper_country, codes, n))

    def counted(rows: DataFrame, keys: list) -> DataFrame:
        """Rows, rows with a country, countries of rows and ``NA`` among them, and the set of all countries, of each key."""
        known = rows.join(sets, "PMID", "left").select(*keys, size().alias("n"), is_na.alias("is_na"), *bits)
        return known.groupBy(*known.columns[: len(keys)]).agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("with_country"), F.sum("n").alias("codes"), F.sum("is_na").alias("na"), *[F.coalesce(F.bit_or(b), F.lit(0).cast("bigint")).alias(b) for b in bits])

    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = ("rows", "with_country", "codes", "na")
    found = written(counted(_reused(transitions), [F.col("PYEAR").alias("focal_year"), "edge_annotation", *TRIPLE]))
    source = found.groupBy("focal_year").agg(F.sum("rows").alias("n_source_transition_rows"), F.sum("with_country").alias("n_source_rows_with_country"), F.sum("codes").alias("n_source_country_rows"), F.sum("na").alias("n_source_country_rows_na_code"))
    by_kind = found.withColumn("edge_annotation", F.explode(_with_pooled())).groupBy("focal_year", "edge_annotation", *TRIPLE).agg(F.sum("with_country").alias("n"), *[F.bit_or(b).alias(b) for b in bits])
    triples = by_kind.groupBy("focal_year", "edge_annotation").agg(F.count("*").alias("n_source_exact_triples"), F.sum("n").alias("n_source_rows_with_country_in_category"), F.sum(size()).alias("n_source_triple_country_rows"))

    later = written(counted(annotated, [F.col("PYEAR").alias("later"), *TRIPLE]).drop(*bits), sets)
    window = F.explode(F.sequence(F.col("later") - w, F.col("later") - 1))
    sizes = later.groupBy("later").agg(*[F.sum(c).alias(c) for c in sums]).select(window.alias("focal_year"), *sums)
    future = sizes.groupBy("focal_year").agg(F.sum("rows").alias("n_future_rows_scanned"), F.sum("with_country").alias("n_future_rows_with_country"), F.sum("codes").alias("n_future_country_rows"), F.sum("na").alias("n_future_country_rows_na_code"))
    known = found.filter("with_country > 0").select("focal_year", *TRIPLE).distinct()
    matched = known.join(later.filter("with_country > 0").select("later", *TRIPLE, "with_country"), list(TRIPLE)).filter(F.col("later").between(F.col("focal_year") + 1, F.col("focal_year") + w))
    matched = matched.groupBy("focal_year").agg(F.sum("with_country").alias("n_future_rows_matched_to_source_exact_triples"))

    weights = ("weight_unique_exact_triples", "weight_unique_source_pmids", "weight_unique_future_pmids", "weight_source_pmid_x_future_pmid")
    edges = network.groupBy("focal_year", "edge_annotation").agg(
        F.count("*").alias("n_country_edges"), F.count_if("is_domestic_adoption").alias("n_domestic_country_edges"), *[F.sum(c).alias(f"total_{c}") for c in weights],
        *[F.sum(F.when(F.col("is_domestic_adoption"), F.col(c))).alias(f"domestic_{c}") for c in (weights[0], weights[3])],
    )
    years = transitions.select(F.col("PYEAR").alias("focal_year")).distinct().withColumn("edge_annotation", F.explode(F.array(*map(F.lit, (*NEW, "Repeated_Triple", POOLED)))))
    out = years
    for part, on in ((source, ["focal_year"]), (future, ["focal_year"]), (matched, ["focal_year"]), (triples, ["focal_year", "edge_annotation"]), (edges, ["focal_year", "edge_annotation"])):
        out = out.join(part, on, "left")
    out = out.select("focal_year", "edge_annotation", *[zero(c).alias(c) for c in out.columns if c not in ("focal_year", "edge_annotation")])
    rates = {"source_row_country_match_rate": ("n_source_rows_with_country", "n_source_transition_rows"), "future_row_country_match_rate": ("n_future_rows_with_country", "n_future_rows_scanned"), "share_domestic_country_edges": ("n_domestic_country_edges", "n_country_edges")}
    return out.withColumns({k: share(F.col(n), F.col(d)) for k, (n, d) in rates.items()} | {"transition_type": F.when(F.col("edge_annotation") == "Repeated_Triple", "Continued").otherwise("Adopted")})


def country_network_by_key(transitions: DataFrame, annotated: DataFrame, paper_country: DataFrame, w: int = 5) -> DataFrame:
    """The earlier variant: New_Node and New_Combination match by pair, New_Relation by triple; a row for each
    focal year, category (pooled too) and pair of countries with later rows and later papers.

    The source countries of a key and focal year are one set of bits.  A later row
    meets the sets of its pair and of its triple once for each focal year of its window; equal sets are
    counted together, by row and by paper, and become countries after that, so nothing
    expands to rows times countries before it is counted.
    """
    home = paper_country.filter(~is_missing(F.col("code"))).select(F.col("pmid").alias("PMID"), "code").distinct()
    # countries are a fixed vocabulary: numbering them is one small table
    codes = written(home.select("code").distinct().withColumn("place", (F.row_number().over(Window.orderBy("code")) - 1).cast("int")))
    n = codes.count()
    if not n:  # no country, no edge
        return home.select(F.lit(0).alias("focal_year"), F.lit("").alias("edge_annotation"), F.col("code").alias("adopter_country_code"), F.col("code").alias("source_country_code"), F.lit(0).cast("bigint").alias("n_future_rows"), F.lit(0).cast("bigint").alias("n_future_pmids"))
    bits = [f"b{k}" for k in range(-(-n // 63))]
    focal = transitions.filter(F.col("edge_annotation").isin(*NEW) & (F.col("future_five_year_transition") == "Adopted")).join(home, "PMID").join(F.broadcast(codes), "code")
    focal = focal.select(F.col("PYEAR").alias("focal_year"), F.col("edge_annotation").alias("kind"), "node_a", "node_b", *TRIPLE, "place").distinct()
    sets = lambda rows, keys: rows.groupBy("focal_year", *keys).agg(*_words(n))
    later = annotated.select("PMID", "PYEAR", "node_a", "node_b", *TRIPLE).distinct().withColumn("focal_year", F.explode(F.sequence(F.col("PYEAR") - w, F.col("PYEAR") - 1)))
    pair, triple = ["node_a", "node_b"], list(TRIPLE)
    met = later
    for kind, keys in ((NEW[0], pair), (NEW[1], pair), (NEW[2], triple)):
        met = met.join(sets(focal.filter(F.col("kind") == kind), keys).withColumnsRenamed({b: f"{kind}_{b}" for b in bits}).withColumn(f"{kind}_met", F.lit(True)), ["focal_year", *keys], "left")
    some = F.coalesce(*[F.col(f"{k}_met") for k in NEW])
    of = lambda kind: F.struct(F.lit(kind).alias("edge_annotation"), *[F.coalesce(f"{kind}_{b}", F.lit(0)).alias(b) for b in bits])
    every = lambda b: F.coalesce(f"{NEW[0]}_{b}", F.lit(0)).bitwiseOR(F.coalesce(f"{NEW[1]}_{b}", F.lit(0))).bitwiseOR(F.coalesce(f"{NEW[2]}_{b}", F.lit(0)))
    pooled = F.struct(F.lit(POOLED).alias("edge_annotation"), *[every(b).alias(b) for b in bits])
    cells = F.array_compact(F.array(*[F.when(F.col(f"{k}_met"), of(k)) for k in NEW], pooled))
    by_paper = met.filter(some).select("focal_year", "PMID", F.explode(cells).alias("c")).select("focal_year", "PMID", "c.*").groupBy("focal_year", "PMID", "edge_annotation", *bits).agg(F.count("*").alias("n_rows"))
    by_paper = written(by_paper)
    scope = ["focal_year", "edge_annotation", "adopter_country_code"]

    def counted(rows: DataFrame, count: str, out: str) -> DataFrame:
        """Sums of ``count`` by adopter and set, then by adopter and source."""
        sums = rows.join(home.withColumnRenamed("code", "adopter_country_code"), "PMID").groupBy(*scope, *bits).agg(F.sum(count).alias("n"))
        return sums.select(*scope, F.explode(_every_place(bits, n)).alias("place"), "n").groupBy(*scope, "place").agg(F.sum("n").alias(out)).join(F.broadcast(codes.withColumnRenamed("code", "source_country_code")), "place").drop("place")

    rows = counted(by_paper, "n_rows", "n_future_rows")
    papers = counted(by_paper.groupBy("focal_year", "PMID", "edge_annotation").agg(*[F.bit_or(b).alias(b) for b in bits], F.lit(1).alias("one")), "one", "n_future_pmids")
    return rows.join(papers, [*scope, "source_country_code"])
