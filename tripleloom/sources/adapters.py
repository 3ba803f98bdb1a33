"""Domain tables out of the order tables: papers are orders, statements are lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Window of years that the seven years of order dates leave room for.
W = 2

#: Rows that one task sorts or groups where tables are dealt by their size.
TASK_ROWS = 500_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def year_bounds(spark: SparkSession, sf_dir: str) -> tuple[int | None, int | None]:
    """The first and the last year of all papers; reads one column."""
    row = load(spark, sf_dir, "orders").selectExpr("year(min(o_orderdate)) a", "year(max(o_orderdate)) b").first()
    return row["a"], row["b"]


def predications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statements in the form of the raw files, with ``source_order``."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    x = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    e = F.expr
    return x.select(
        e("concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))").alias("PREDICATION_ID"),
        e("concat_ws('.', l_orderkey, l_linenumber % 3)").alias("SENTENCE_ID"),
        e("cast(l_orderkey as string)").alias("PMID"),
        e("concat(l_returnflag, l_linestatus)").alias("PREDICATE"),
        e("concat(CASE WHEN l_linenumber = 1 THEN concat('K', o_custkey) ELSE concat('C', l_partkey % 200) END, CASE WHEN l_quantity > 40 THEN concat('|X', l_partkey % 7) ELSE '' END)").alias("SUBJECT_CUI"),
        e("concat(p_name, CASE WHEN l_quantity > 45 THEN '|other' ELSE '' END)").alias("SUBJECT_NAME"),
        e("p_type").alias("SUBJECT_SEMTYPE"),
        e("CASE WHEN l_discount = 0 THEN '0' ELSE '1' END").alias("SUBJECT_NOVELTY"),
        e("CASE WHEN l_linenumber = 2 OR (l_linenumber = 1 AND l_quantity > 25) THEN concat('K', (o_custkey * 7 + l_suppkey) % 3000) ELSE concat('C', (l_suppkey * 7 + l_linenumber * 13) % 100) END").alias("OBJECT_CUI"),
        e("s_name").alias("OBJECT_NAME"),
        e("p_brand").alias("OBJECT_SEMTYPE"),
        e("CASE WHEN l_tax = 0 THEN '0' ELSE '1' END").alias("OBJECT_NOVELTY"),
        e("struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice)").alias("source_order"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PMID, ISSN, DP, EDAT, PYEAR of each order; the dates are off for some."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    y = "year(o_orderdate)"
    return o.selectExpr(
        "cast(o_orderkey as string) PMID", "concat('ISSN-', o_custkey % 50) ISSN",
        f"concat({y} + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END, ' Jan') DP",
        f"CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE concat({y}, '/01/02') END EDAT",
        f"CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE cast({y} as string) END PYEAR",
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with integer years and short names (PMID, PYEAR, s, p, o), one for each line."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "cast(l_orderkey as string) PMID", "year(o_orderdate) PYEAR",
        "CASE WHEN l_linenumber = 1 THEN concat('K', o_custkey) ELSE concat('C', l_partkey % 200) END s",
        "concat(l_returnflag, l_linestatus) p",
        "CASE WHEN l_linenumber = 2 OR (l_linenumber = 1 AND l_quantity > 25) THEN concat('K', (o_custkey * 7 + l_suppkey) % 3000) ELSE concat('C', (l_suppkey * 7 + l_linenumber * 13) % 100) END o",
    ).distinct()


def paper_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pmid, code, name``: the nations of an order's suppliers."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    nation = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "s_nationkey")
    return lines.join(nation, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr("cast(l_orderkey as string) pmid", "concat('N', s_nationkey) code", "n_name name").distinct()


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of works, dealt by work to as many tasks as the row count asks for; what groups or joins them by work stays in these tasks."""
    every = load(spark, sf_dir, "lineitem")
    lines = every.select("l_orderkey", "l_linenumber", "l_suppkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(every.count() / TASK_ROWS))
    rows = lines.join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "concat('W', l_orderkey) work_id", "concat('A', l_suppkey) author_id",
        "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE concat('I', s_nationkey, '-', l_suppkey % 5) END institution_id",
        "CASE WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber = 7 THEN 'last' ELSE 'middle' END author_position",
    )
    return rows.repartition(tasks, "work_id").distinct()


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions, some in two versions, some without a code."""
    both = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.selectExpr(
        "concat('I', s_nationkey, '-', s_suppkey % 5) institution_id", "concat('Institute ', s_nationkey, '-', s_suppkey % 5) display_name",
        "CASE WHEN s_nationkey % 6 = 0 THEN ' ' WHEN s_nationkey % 5 = 0 THEN lower(substr(n_name, 1, 2)) ELSE substr(n_name, 1, 2) END country_code",
        "CASE WHEN s_nationkey % 12 = 0 THEN NULL ELSE substr(n_name, 1, 2) END geo_code",
        "CASE WHEN s_nationkey = 12 THEN 'Namibia' ELSE n_name END country_name", "s_suppkey version",
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``work_id, referenced_work_id``: each line cites an order."""
    n = load(spark, sf_dir, "orders").count()
    return load(spark, sf_dir, "lineitem").selectExpr("concat('W', l_orderkey) work_id", f"concat('W', (l_partkey * 7919 + l_suppkey * 31 + l_linenumber) % {n}) referenced_work_id")


def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``work_id, pmid, doi`` as text: some papers with two works, some works with two papers, some odd spellings."""
    o = load(spark, sf_dir, "orders").select("o_orderkey").filter("o_orderkey % 10 <> 9")
    one = o.selectExpr(
        "concat(CASE WHEN o_orderkey % 7 = 0 THEN 'https://openalex.org/' ELSE '' END, 'W', o_orderkey) work_id",
        "CASE WHEN o_orderkey % 13 = 0 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', o_orderkey) WHEN o_orderkey % 101 = 0 THEN 'none' ELSE cast(o_orderkey as string) END pmid",
        "concat('https://doi.org/10.1/', o_orderkey, 'A') doi",
    )
    two = o.filter("o_orderkey % 17 = 0").selectExpr("concat('W9', o_orderkey, '00') work_id", "cast(o_orderkey as string) pmid", "CASE WHEN o_orderkey % 34 = 0 THEN NULL ELSE concat('10.2/', o_orderkey) END doi")
    shared = o.filter("o_orderkey % 29 = 0").selectExpr("concat('W', o_orderkey) work_id", "cast(o_orderkey + 1 as string) pmid", "concat('https://doi.org/10.1/', o_orderkey, 'a') doi")
    return one.union(two).union(shared)


def work_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").filter("o_orderkey % 19 <> 0")
    one = o.selectExpr("concat('W', o_orderkey) work_id", "CASE WHEN o_orderkey % 41 = 0 THEN '2e3' ELSE cast(year(o_orderdate) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END as string) END publication_year")
    two = o.filter("o_orderkey % 17 = 0").selectExpr("concat('W9', o_orderkey, '00') work_id", "cast(year(o_orderdate) as string) publication_year")
    return one.union(two)


#: Further fields of a second source's papers, as expressions over the order.
SOURCE_FIELDS = {
    "doi": "CASE WHEN o_orderkey % 12 <> 0 THEN concat('10.1/', o_orderkey) END", "date": "concat(1995 + o_orderkey % 7, '-01-02')", "doctype": "CASE WHEN o_orderkey % 9 = 0 THEN 'Book' ELSE 'Journal' END",
    "cited_by_count": "o_custkey % 70", "is_retracted": "o_orderkey % 50 = 0", "reference_count": "o_orderkey % 33", "citation_count": "o_custkey % 71",
    "disruption": "CASE WHEN o_custkey % 4 <> 0 THEN (o_orderkey % 21 - 10) / 16e0 END", "Atyp_Median_Z": "CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey % 400 / 8e0 END", "Atyp_10pct_Z": "CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey % 300 / 8e0 - 20 END", "Atyp_Pairs": "o_orderkey % 90",
    "WSB_mu": "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 60 / 4e0 END", "WSB_sigma": "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 20 / 4e0 END", "WSB_Cinf": "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 500 / 2e0 END", "SB_B": "o_orderkey % 64 / 4e0", "SB_T": "o_orderkey % 15",
    "institution_count": "o_custkey % 6 + 1", "patent_count": "o_custkey % 3", "newsfeed_count": "o_orderkey % 4", "nct_count": "o_orderkey % 2", "nih_count": "o_custkey % 5", "nsf_count": "o_orderkey % 3",
}


def source_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paperid, year, C3, C5, C10, team_size`` and SOURCE_FIELDS of a second source."""
    o = load(spark, sf_dir, "orders").filter("o_orderkey % 19 <> 1").select("o_orderkey", "o_orderdate", "o_custkey")
    return o.selectExpr(
        "concat('W', o_orderkey) paperid", "CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE cast(year(o_orderdate) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END as string) END year",
        "o_custkey % 9 C3", "o_custkey % 14 C5", "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 30 END C10", "o_custkey % 12 + 1 team_size",
        *[f"{e} {c}" for c, e in SOURCE_FIELDS.items()],
    )


def concept_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").selectExpr("concat('C', vec_id) concept", "embedding vector")


#: Plain fields and nested records of a work, as expressions over its number.
WORK_FIELDS = {
    "doi": "CASE WHEN l_orderkey % 5 <> 0 THEN concat('https://doi.org/10.1/', l_orderkey) END", "title": "concat('Title ', l_orderkey)", "display_name": "concat('Title ', l_orderkey)",
    "publication_year": "CASE WHEN l_orderkey % 19 <> 0 THEN cast(1995 + l_orderkey % 7 as int) END", "publication_date": "concat(1995 + l_orderkey % 7, '-01-02')", "type": "CASE WHEN l_orderkey % 6 = 0 THEN 'book' ELSE 'article' END",
    "cited_by_count": "l_orderkey % 40", "is_retracted": "l_orderkey % 50 = 0", "is_paratext": "l_orderkey % 60 = 0", "language": "CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE 'en' END",
    "abstract_inverted_index": "CASE WHEN l_orderkey % 2 = 0 THEN map('word', array(0, cast(l_orderkey % 3 + 1 as int))) END",
    "ids": "CASE WHEN l_orderkey % 4 <> 3 THEN struct(concat('W', l_orderkey) AS openalex, CASE WHEN l_orderkey % 5 <> 0 THEN concat('https://doi.org/10.1/', l_orderkey) END AS doi, cast(l_orderkey * 3 as string) AS mag, cast(l_orderkey as string) AS pmid) END",
    "open_access": "CASE WHEN l_orderkey % 9 <> 0 THEN struct(l_orderkey % 4 = 0 AS is_oa, CASE WHEN l_orderkey % 4 = 0 THEN 'gold' ELSE 'closed' END AS oa_status, CASE WHEN l_orderkey % 4 = 0 THEN concat('http://x/', l_orderkey) END AS oa_url) END",
    "biblio": "CASE WHEN l_orderkey % 11 <> 0 THEN struct(cast(l_orderkey % 12 as string) AS volume, cast(l_orderkey % 4 as string) AS issue, cast(l_orderkey % 90 as string) AS first_page, cast(l_orderkey % 90 + 9 as string) AS last_page) END",
}


def snapshot_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested works out of the order lines, in the form of a snapshot's records."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").distinct()
    author = F.expr(
        "struct(CASE WHEN l_linenumber = 1 THEN 'first' ELSE 'middle' END AS author_position, struct(CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE concat('A', l_suppkey) END AS id) AS author, "
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(array() as array<struct<id:string>>) ELSE array(struct(concat('I', l_suppkey % 25) AS id), struct(concat('I', l_partkey % 7) AS id)) END AS institutions)"
    )
    topic = F.expr("struct(concat('T', l_partkey % 50) AS id, l_quantity / 50 AS score)")
    place = F.expr("struct(struct(CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('S', l_suppkey) END AS id) AS source, concat('http://x/', l_partkey) AS landing_page_url, concat('http://x/', l_partkey, '.pdf') AS pdf_url, l_returnflag = 'N' AS is_oa, CASE WHEN l_quantity > 25 THEN 'publishedVersion' END AS version, lower(l_returnflag) AS license)")
    rows = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(author)).alias("authorships"), F.array_sort(F.collect_list(topic)).alias("topics"), F.array_sort(F.collect_list(place)).alias("locations"),
        F.array_sort(F.collect_list(F.expr("concat('W', l_partkey)"))).alias("referenced_works"), F.min(place).alias("primary_location"),
    )
    return rows.select(
        F.expr("concat('W', l_orderkey)").alias("id"), "authorships", "topics", F.expr("cast(NULL as array<struct<id:string,score:double>>)").alias("concepts"),
        F.expr("array(struct(concat('D', l_orderkey % 9) AS descriptor_ui, l_orderkey % 2 = 0 AS is_major_topic))").alias("mesh"), "locations", "primary_location", F.expr("CASE WHEN l_orderkey % 4 = 0 THEN primary_location END").alias("best_oa_location"),
        "referenced_works", F.expr("CASE WHEN l_orderkey % 3 = 0 THEN array(concat('W', l_orderkey + 1)) END").alias("related_works"),
        *[F.expr(e).alias(c) for c, e in WORK_FIELDS.items()],
    )


def snapshot_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of suppliers and customers as entities, some in two versions."""
    sup = load(spark, sf_dir, "supplier").selectExpr("'source' kind", "concat('S', s_suppkey % 60) id", "s_suppkey n", "s_nationkey k")
    cus = load(spark, sf_dir, "customer").selectExpr("'author' kind", "concat('A', c_custkey % 900) id", "c_custkey n", "c_nationkey k")
    return sup.union(cus).selectExpr(
        "kind", "id", "concat('2024-01-', lpad(cast(n % 28 + 1 as string), 2, '0'), 'T', lpad(cast(n as string), 8, '0')) updated_date", "concat('{\"own\":\"', id, '\",\"wiki\":\"Q', n, '\"}') ids_json",
        "array(struct(2000 AS year, n % 7 AS works_count, n % 11 AS cited_by_count), struct(2001 AS year, k AS works_count, n AS cited_by_count)) counts_by_year",
        "concat(kind, ' ', n) display_name", "array(concat('Alias ', n), concat('Other ', k)) alternatives", "n % 500 works_count", "n % 900 cited_by_count", "CASE WHEN k % 4 <> 0 THEN struct(concat('City ', n % 30) AS city, concat('N', k) AS country_code, k / 2.0D AS latitude, n % 90 + 0.5D AS longitude) END geo",
        "CASE WHEN n % 3 = 0 THEN array(struct(concat('E', k) AS id, 'parent' AS relationship), struct(cast(NULL as string) AS id, 'child' AS relationship)) END associated", "array(struct(concat('P', k) AS id), struct(cast(NULL as string) AS id)) ancestors",
        "CASE WHEN n % 5 = 0 THEN array(struct(concat('R', n % 17) AS id, k / 4.0D AS score)) END related",
    )
