"""What the operators of this subpackage share.

``stash(df, *done)`` writes a table to the folder that driver and executors
share, reads it back and deletes earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove as drop
from ..sources.shared import shared_dir
from ..sources.shared import written as stash

#: Rows of an Arrow batch that are turned into Python objects at a time, so
#: that a batch of very long texts is never held twice as a whole.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus


def texts_of(column, start: int, size: int = SLICE) -> list:
    """A slice of an Arrow string column as Python strings, null as ``''``."""
    return [t or "" for t in column.slice(start, size).to_pylist()]


#: Rows of a narrow table (a few numbers each) that a broadcast may hold: below 100 MB.
SMALL_ROWS = 500_000


def narrow(df: DataFrame) -> DataFrame:
    """A narrow table that was stashed, for a join: its rows are counted, and up
    to SMALL_ROWS of them are broadcast, so that wide rows aren't shuffled."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def join_narrow(df: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """``df`` joined with a :func:`narrow` table."""
    return df.join(narrow(side), on, how)


def sampled(labels: DataFrame, seed: str, most: int) -> DataFrame:
    """Of ``labels(id, ...)`` about ``most`` rows, chosen by a hash of the id; all, if there are no more."""
    share = min(1.0, most / max(labels.count(), 1))
    return labels.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) < F.lit(int(share * (1 << 53))))
