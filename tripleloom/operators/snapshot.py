"""Flattening a nested snapshot of works and entities into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<source:struct<id:string>,landing_page_url:string,pdf_url:string,is_oa:boolean,version:string,license:string>"
#: The columns that the flattening reads, as a schema for the reader.
WORK_SCHEMA = (
    f"id string, doi string, title string, display_name string, publication_year int, publication_date string, type string, cited_by_count bigint, is_retracted boolean, is_paratext boolean, language string, abstract_inverted_index map<string,array<int>>, "
    f"ids struct<openalex:string,doi:string,mag:string,pmid:string>, primary_location {LOCATION}, best_oa_location {LOCATION}, locations array<{LOCATION}>, "
    "authorships array<struct<author_position:string,author:struct<id:string>,institutions:array<struct<id:string>>>>, topics array<struct<id:string,score:double>>, concepts array<struct<id:string,score:double>>, mesh array<struct<descriptor_ui:string,is_major_topic:boolean>>, "
    "open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, referenced_works array<string>, related_works array<string>"
)
WORK_COLUMNS = ("id", "doi", "title", "display_name", "publication_year", "publication_date", "type", "cited_by_count", "is_retracted", "is_paratext", "language")


def flatten_works(works: DataFrame) -> DataFrame:
    """A row for each work with an id: its plain fields, the inverted abstract as JSON text."""
    return works.filter("id is not null").select(*WORK_COLUMNS, F.to_json("abstract_inverted_index").alias("abstract_inverted_index"))


def flatten_publication_years(works: DataFrame) -> DataFrame:
    return works.filter("id is not null and publication_year is not null").select(F.col("id").alias("work_id"), "publication_year")


def flatten_record(works: DataFrame, field: str) -> DataFrame:
    """The fields of a nested record (``ids``, ``open_access``, ``biblio``), a row for each work that has one."""
    return works.filter(F.col("id").isNotNull() & F.col(field).isNotNull()).select(F.col("id").alias("work_id"), f"{field}.*")


def flatten_authorships(works: DataFrame) -> DataFrame:
    """A row for each author and institution; an author without institutions keeps a row, one without an id has none."""
    one = works.select(F.col("id").alias("work_id"), F.explode("authorships").alias("a")).filter(F.col("a.author.id").isNotNull())
    return one.select("work_id", F.col("a.author_position").alias("author_position"), F.col("a.author.id").alias("author_id"), F.explode_outer("a.institutions").alias("i")).select("work_id", "author_position", "author_id", F.col("i.id").alias("institution_id"))


def flatten_references(works: DataFrame) -> DataFrame:
    """Referenced and related works in one table."""
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.array().cast("array<string>")).alias("l")) for k, c in (("referenced", "referenced_works"), ("related", "related_works"))])
    return works.select(F.col("id").alias("work_id"), F.explode(lists).alias("x")).select("work_id", "x.kind", F.explode("x.l").alias("other_work_id"))


def flatten_locations(works: DataFrame) -> DataFrame:
    """Primary, best and all locations that have a source."""
    every = F.concat(
        F.array(F.struct(F.lit("primary").alias("kind"), F.col("primary_location").alias("l")), F.struct(F.lit("best_oa").alias("kind"), F.col("best_oa_location").alias("l"))),
        F.transform(F.coalesce("locations", F.array().cast(f"array<{LOCATION}>")), lambda x: F.struct(F.lit("any").alias("kind"), x.alias("l"))),
    )
    return works.select(F.col("id").alias("work_id"), F.explode(every).alias("x")).filter(F.col("x.l.source.id").isNotNull()).select("work_id", "x.kind", F.col("x.l.source.id").alias("source_id"), *[F.col(f"x.l.{c}").alias(c) for c in ("landing_page_url", "pdf_url", "is_oa", "version", "license")])


def flatten_work_terms(works: DataFrame) -> DataFrame:
    """Topics and concepts with their scores, headings with a score of 1 if major."""
    t = lambda kind, c, f: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.struct(F.lit(kind).alias("kind"), f(x)[0].alias("term_id"), f(x)[1].alias("score")))
    terms = F.concat(t("topic", "topics", lambda x: (x["id"], x["score"])), t("concept", "concepts", lambda x: (x["id"], x["score"])), t("mesh", "mesh", lambda x: (x["descriptor_ui"], F.when(x["is_major_topic"], F.lit(1.0)).otherwise(F.lit(0.0)))))
    return works.select(F.col("id").alias("work_id"), F.explode(terms).alias("x")).select("work_id", "x.*")


def latest_entities(entities: DataFrame) -> DataFrame:
    """One record for each id: the one updated last (ties: the largest of the rest)."""
    rest = [c for c in entities.columns if c not in ("kind", "id")]
    return entities.filter("id is not null").groupBy("kind", "id").agg(F.max_by(F.struct(*rest), F.struct("updated_date", "ids_json")).alias("x")).select("kind", "id", "x.*")


def flatten_entities(entities: DataFrame) -> DataFrame:
    """The plain fields of each record; lists as JSON text."""
    return latest_entities(entities).select("kind", "id", "display_name", F.to_json("alternatives").alias("alternatives"), "works_count", "cited_by_count", "updated_date")


def flatten_entity_geo(entities: DataFrame) -> DataFrame:
    """``kind, id`` and the place of each record that has one."""
    return latest_entities(entities).filter("geo is not null").select("kind", "id", "geo.*")


def flatten_entity_links(entities: DataFrame, field: str) -> DataFrame:
    """``kind, id, other_id`` and the rest of a list of records (``associated``, ``ancestors``, ``related``); entries without an id are left out."""
    inner = entities.schema[field].dataType.elementType.fieldNames()
    rows = latest_entities(entities).select("kind", "id", F.explode(field).alias("x")).filter("x.id is not null")
    return rows.select("kind", "id", F.col("x.id").alias("other_id"), *[F.col(f"x.{c}").alias(c) for c in inner if c != "id"])


def flatten_entity_counts(entities: DataFrame) -> DataFrame:
    """``kind, id, year, works_count, cited_by_count``."""
    return latest_entities(entities).select("kind", "id", F.explode("counts_by_year").alias("c")).select("kind", "id", "c.year", "c.works_count", "c.cited_by_count")


def flatten_entity_ids(entities: DataFrame) -> DataFrame:
    """``kind, id, scheme, value`` out of the JSON map of identifiers."""
    return latest_entities(entities).select("kind", "id", F.explode(F.from_json("ids_json", "map<string,string>")).alias("scheme", "value"))
