"""Readers and writers with fixed conventions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the raw files, which have no headers.
PREDICATION_COLUMNS = ("PREDICATION_ID", "SENTENCE_ID", "PMID", "PREDICATE", "SUBJECT_CUI", "SUBJECT_NAME", "SUBJECT_SEMTYPE", "SUBJECT_NOVELTY", "OBJECT_CUI", "OBJECT_NAME", "OBJECT_SEMTYPE", "OBJECT_NOVELTY", "M", "N", "O")
CITATION_COLUMNS = ("PMID", "ISSN", "DP", "EDAT", "PYEAR")


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw_csv(spark: SparkSession, path: str, columns: Sequence[str], bad: str | None = None) -> DataFrame:
    r"""Delimited text without a header, all strings, ``\` escapes, ``\N`` is null.

    With ``bad``, a column of that name has the whole line where it has too many or too few
    fields, for :func:`line_account` to count and :func:`good_lines` to drop.
    """
    schema = _strings([*columns, bad] if bad else columns)
    more = {"columnNameOfCorruptRecord": bad, "columnPruning": "false", "mode": "PERMISSIVE"} if bad else {}
    return spark.read.options(**more).csv(path, schema=schema, quote='"', escape="\\", encoding="ISO-8859-1", nullValue="\\N")


def good_lines(raw: DataFrame, bad: str) -> DataFrame:
    """The lines that have all fields and no more."""
    return raw.filter(F.col(bad).isNull()).drop(bad)


def line_account(raw: DataFrame, bad: str) -> DataFrame:
    """One row: lines, good and bad ones, their share, good ones without their first field, and the least bad line as an example."""
    wrong, first = F.col(bad).isNotNull(), F.col(raw.columns[0])
    out = raw.agg(F.count("*").alias("n_lines"), F.count_if(~wrong).alias("n_good_lines"), F.count_if(wrong).alias("n_bad_lines"), F.count_if(~wrong & first.isNull()).alias("n_good_lines_without_first"), F.min(bad).alias("example"))
    return out.withColumn("share_bad_lines", F.try_divide(F.col("n_bad_lines").cast("double"), F.col("n_lines")))


def null_marker(df: DataFrame, marker: str = "\\N") -> DataFrame:
    """String columns with the marker turned into nulls."""
    return df.select(*[F.nullif(F.col(f.name), F.lit(marker)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Delimited text with a header, all strings, doubled quotes, blank is null."""
    return spark.read.csv(path, schema=_strings(columns), header=True, escape='"', nullValue="")


def read_years(spark: SparkSession, root: str, first: int, last: int, column: str = "PYEAR") -> DataFrame:
    """Some years of a table partitioned by year; other years aren't read."""
    return spark.read.parquet(root).filter(F.col(column).between(first, last))


def read_snapshot(spark: SparkSession, root: str, entity: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a snapshot's entity."""
    return spark.read.schema(schema).json(f"{root}/data/{entity}/*/*.gz")


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), partition: Sequence[str] = (), rows_per_file: int = 0) -> None:
    """Parquet with zstd, sorted within its files."""
    ordered = df.sortWithinPartitions(*order) if order else df
    writer = ordered.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """One file of a small result."""
    one = df.coalesce(1).write
    one.csv(path, header=True) if form == "csv" else one.json(path)
