"""Large tables on disk: shards of exact size, tables in a global order with a
manifest that readers skip files by, years that are replaced one by one, and
tables that are published only as they were checked.

Nothing here depends on how the rows were dealt to partitions before: the
same rows give the same files.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .shared import _at, remove, written

#: Rows of a range that one task orders, and ranges whose sizes are summed in one task.
RANGE_ROWS, SUMMED = 1_000_000, 1024


def _numbered(df: DataFrame, order: Sequence[str], range_rows: int) -> tuple[DataFrame, int]:
    """:func:`numbered`, and the number of its ranges."""
    every = [*order, *[c for c in df.columns if c not in order]]
    ranges = max(1, math.ceil(df.count() / range_rows))
    own = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1  # the lower 33 bits are a row's place in its partition
    ranged = written(df.repartitionByRange(ranges, *every).sortWithinPartitions(*every).withColumns({"__range": F.spark_partition_id(), "__own": own}))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__block", F.floor(F.col("__range") / SUMMED))
    blocks = sizes.groupBy("__block").agg(F.sum("__n").alias("__b")).withColumn("__earlier", F.sum("__b").over(Window.orderBy("__block")) - F.col("__b"))  # a row for SUMMED ranges
    inside = F.sum("__n").over(Window.partitionBy("__block").orderBy("__range")) - F.col("__n")
    before = sizes.withColumn("__inside", inside).join(blocks, "__block").select("__range", (F.col("__inside") + F.col("__earlier")).alias("__before"))
    side = F.broadcast(before) if ranges <= 500_000 else before
    return ranged.join(side, "__range").select(*df.columns, (F.col("__own") + F.col("__before")).alias("number")), ranges


def numbered(df: DataFrame, order: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``number``, a row's place in the order from 1 on; ties by the other columns.

    Rows are dealt to ranges of the key, as many as the row count asks for (Spark
    samples a hundred keys a range for their borders), numbered inside each as they are written
    in order, and moved on by the sizes of the ranges before.  Those are summed in blocks and then
    over blocks, so no task sees the table or all of its ranges.
    """
    return _numbered(df, order, range_rows)[0]


#: Bytes of a row group, the most that a task holds of a shard.
GROUP_BYTES = 64 << 20


def _local(spark: SparkSession, path: str) -> str | None:
    """The plain name of a path in a file system that tasks see as files, if it is one."""
    at, system = _at(spark, path)
    uri = system.makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _shard_files(folder: str, key: str):
    """For tasks whose rows are sorted by shard: a file for each shard, and ``shard, key`` of its rows as read back from it.

    A file gets its name when it is complete, and another attempt of the task replaces it by an equal one.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        def files():
            last = writer = name = None
            held: list = []

            def flush():
                if held:
                    writer.write_table(pa.Table.from_batches(held))
                held.clear()

            def close():
                flush()
                writer.close()
                os.replace(f"{os.path.dirname(name)}/.{mine}", name)
                return last, name

            mine = uuid.uuid4().hex
            try:
                for batch in batches:
                    shards, batch = batch.column("shard").to_numpy(), batch.drop_columns(["shard"])
                    cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                    for start, end in zip(cuts, cuts[1:]) if len(shards) else ():
                        if shards[start] != last:
                            if writer:
                                yield close()
                                writer = None
                            if last is not None and shards[start] < last:
                                raise ValueError(f"shard {shards[start]} came after {last}")
                            last = int(shards[start])
                            name = f"{folder}/shard={last}/part-{last:09d}.zstd.parquet"
                            os.makedirs(os.path.dirname(name), exist_ok=True)
                            writer = pq.ParquetWriter(f"{os.path.dirname(name)}/.{mine}", batch.schema, compression="zstd")
                        held.append(batch.slice(start, end - start))
                        if sum(x.nbytes for x in held) > GROUP_BYTES:
                            flush()
                if writer:
                    yield close()
                    writer = None
            finally:
                if writer:
                    writer.close()
                    os.remove(f"{os.path.dirname(name)}/.{mine}")

        for shard, name in files():
            with pq.ParquetFile(name) as file:
                for batch in file.iter_batches(columns=[key]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), shard)), batch.column(0)], ["shard", key])

    return run


def _shard_sums(files):
    """The batches of ``files`` (``shard, key`` of one file, in order) as a row each: ``shard, n_rows, first_key, last_key``."""

    def run(batches):
        import pyarrow as pa

        def row(batch):
            known = batch.column(1).drop_null()
            ends = [known.take(pa.array([i])) if len(known) else pa.nulls(1, known.type) for i in (0, len(known) - 1)]
            return pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([len(batch)]), *ends], ["shard", "n_rows", "first_key", "last_key"])

        rows = map(row, files(batches))
        while some := list(islice(rows, 1000)):
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    return run


def write_shards(df: DataFrame, path: str, order: Sequence[str], rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` in zstd files of exactly ``rows`` rows, the last one shorter, in a global order; returns the manifest.

    A file is a folder ``shard=k``; equal tables give equal files, whatever their
    partitions.  The manifest (shard, n_rows, first and last of the leading key)
    is counted from the files, kept as ``_manifest`` beside them, and must add up to the rows that were numbered.

    A task writes shards that follow one another, about ``range_rows`` rows of them.
    On a disk, tasks write the files by Arrow and read each back at once: Hadoop's local file system
    starts processes for the mode of each file and folder, and a table of many files is slow to list.
    Elsewhere Spark's own writer is used.
    """
    spark = df.sparkSession
    at, system = _at(spark, path)
    if system.exists(at):
        raise ValueError(f"{path} exists")
    numbers, ranges = _numbered(df, order, range_rows)
    placed = numbers.withColumn("shard", F.ceil(F.col("number") / rows))
    seen = Observation()
    task = F.floor((F.col("shard") - 1) / math.ceil(range_rows / rows)).cast("int")
    local = _local(spark, path)
    dealt = placed.repartitionById(ranges, task).sortWithinPartitions(*(["number"] if local else ["shard", "number"])).observe(seen, F.count("*").alias("n"))
    if local:
        key = placed.schema[order[0]].dataType
        sums = placed.select("shard").schema.add("n_rows", "long").add("first_key", key).add("last_key", key)
        files = dealt.mapInArrow(_shard_sums(_shard_files(local, order[0])), sums)
    else:
        dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
        key = F.col(order[0])
        files = spark.read.schema(placed.schema).parquet(path).select("shard", F.lit(1).alias("n_rows"), key.alias("first_key"), key.alias("last_key"))
    manifest = files.groupBy("shard").agg(F.sum("n_rows").alias("n_rows"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    manifest.coalesce(1).write.parquet(f"{path}/_manifest")
    kept = spark.read.schema(manifest.schema).parquet(f"{path}/_manifest")
    total = kept.agg(F.sum("n_rows").alias("n"), F.count_if(F.col("n_rows") != rows).alias("short")).first()
    wanted = seen.get["n"] if total["n"] else placed.count()  # a plan that Spark finds empty observes nothing
    if (total["n"] or 0) != wanted or total["short"] > 1:
        raise ValueError(f"{wanted} rows became {total['n']} in files, {total['short']} of them short")
    return kept


def read_range(spark: SparkSession, path: str, column: str, low, high) -> DataFrame:
    """Rows of :func:`write_shards` with the leading key from ``low`` to ``high``; other files aren't opened.

    The names of the files that may hold some (one for each shard) reach the driver, not those of all.
    """
    manifest = spark.read.parquet(f"{path}/_manifest")
    shards = [r["shard"] for r in manifest.filter((F.col("last_key") >= F.lit(low)) & (F.col("first_key") <= F.lit(high))).select("shard").collect()]
    folders = [f"{path}/shard={k}" for k in sorted(shards)] or [f"{path}/shard=1"]
    rows = spark.read.parquet(*folders).filter(F.col(column).between(low, high))
    return rows.drop("number") if shards else rows.drop("number").limit(0)


def write_years(df: DataFrame, path: str, bounds: tuple[int | None, int | None], column: str = "PYEAR") -> DataFrame:
    """Replace the years that ``df`` has in a table split by year; others stay as they are.

    Returns ``column, source_rows, written_rows, passed`` for each year from
    ``bounds``, and the null year for all else.  Source rows are counted as
    they are written, written ones from the files.
    """
    spark = df.sparkSession
    first, last = (bounds[0] or 0), (-1 if bounds[1] is None else bounds[1])
    years, year = range(first, last + 1), F.col(column).cast("int")
    seen = Observation()
    counts = [F.count_if(year == y).alias(f"y{y}") for y in years]
    rows = df.hint("rebalance", column).observe(seen, F.count("*").alias("n"), *counts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(column).parquet(path)
    source = {y: seen.get[f"y{y}"] for y in years}
    source = {y: n for y, n in source.items() if n} | {None: seen.get["n"] - sum(source.values())}
    wanted = spark.createDataFrame([(y, n) for y, n in source.items() if n], f"{column} int, source_rows long")
    files = spark.read.schema(df.schema).parquet(path).groupBy(year.alias("__y")).agg(F.count("*").alias("n"))
    inside = F.when(F.col("__y").between(first, last), F.col("__y"))
    found = files.groupBy(inside.alias("__y")).agg(F.sum("n").alias("written_rows"))
    met = wanted.join(found, F.col(column).eqNullSafe(F.col("__y")), "left").drop("__y").withColumn("written_rows", F.coalesce("written_rows", F.lit(0)))
    return met.withColumn("passed", F.col("source_rows") == F.col("written_rows"))


def publish(df: DataFrame, path: str, rules: dict[str, Column], checks: Callable[[DataFrame], DataFrame] | None = None, order: Sequence[str] = ()) -> str:
    """Write a new version of a table and make it the current one if nothing is wrong with it.

    ``rules`` are conditions that no row may meet; they are counted in the very pass that
    writes the staged files.  ``checks`` gives ``rule, n_violations`` of the staged files as
    read back.  Either way what was checked is what is published, whatever
    happens to the input meanwhile.  A version is published by one rename
    of its manifest; a failed one is deleted, and raises a ValueError.
    """
    spark = df.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    staged = f"{path}/{name}"
    seen = Observation()
    ordered = df.sortWithinPartitions(*order) if order else df
    watched = ordered.observe(seen, F.count("*").alias("n"), *[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    watched.write.option("compression", "zstd").parquet(staged)
    bad = {rule: seen.get[f"r{i}"] for i, rule in enumerate(rules) if seen.get[f"r{i}"]}
    files = spark.read.schema(df.schema).parquet(staged)
    if (n := files.count()) != seen.get["n"]:
        bad["rows written"] = seen.get["n"] - n
    if checks and not bad:
        bad = {r["rule"]: r["n_violations"] for r in checks(files).filter(F.coalesce("n_violations", F.lit(1)) > 0).limit(20).collect()}
    if bad:
        remove(spark, staged)
        raise ValueError("not published: " + "; ".join(f"{k}: {v}" for k, v in bad.items()))
    _commit(spark, path, {"folder": name, "rows": seen.get["n"], "rules": [*rules]})
    return staged


def _places(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_published")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    at, system = _places(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at) if s.getPath().getName().isdigit()) if system.exists(at) else []


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """The next manifest, written aside and renamed; a rename fails if another writer was first, and the next number is tried."""
    at, system = _places(spark, path)
    system.mkdirs(at)
    to = spark._jvm.org.apache.hadoop.fs.Path
    aside = to(at, f".{uuid.uuid4().hex}")
    out = system.create(aside)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    for _ in range(100):
        if system.rename(aside, to(at, f"{int((_versions(spark, path) or ['0'])[-1]) + 1:010d}")):
            return
    raise OSError(f"no manifest could be renamed in {at}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"nothing is published at {path}")
    manifest = json.loads(spark.read.text(f"{path}/_published/{versions[-1]}").first()[0])
    return spark.read.parquet(f"{path}/{manifest['folder']}")
