"""Shards, ordered tables, years, publishing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tripleloom.sources import tables


def files(path: str, spark) -> dict:
    """Rows of each shard in the order of its file."""
    out = {}
    for name in sorted(os.listdir(path)):
        if name.startswith("shard="):
            parts = [f for f in os.listdir(f"{path}/{name}") if f.endswith(".parquet")]
            assert len(parts) == 1 and ".zstd." in parts[0]
            out[int(name[6:])] = [tuple(r) for r in spark.read.parquet(f"{path}/{name}/{parts[0]}").drop("number").collect()]
    return out


def test_shards_have_exact_sizes_and_the_same_content_for_any_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SUMMED", 3)
    rows = [(k * 7 % 50, k % 3, "x") for k in range(333)] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "k long, v long, n string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    manifest = sorted(map(tuple, tables.write_shards(df.repartition(7), a, ["k"], 100, range_rows=40).collect()))
    tables.write_shards(df.coalesce(1), b, ["k"], 100, range_rows=1000)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert files(a, spark) == files(b, spark) == {i + 1: ordered[100 * i : 100 * i + 100] for i in range(4)}
    assert manifest == [(i + 1, len(part), min(known), max(known)) for i, part in enumerate(ordered[100 * i : 100 * i + 100] for i in range(4)) if (known := [r[0] for r in part if r[0] is not None])]
    assert tables.write_shards(df.limit(0), str(tmp_path / "c"), ["k"], 10).count() == 0


def test_a_range_opens_only_its_shards(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    path = str(tmp_path / "t")
    tables.write_shards(df, path, ["id"], 100)
    got = tables.read_range(spark, path, "id", 250, 333)
    assert sorted(r.id for r in got.collect()) == [*range(250, 334)]
    assert {os.path.basename(os.path.dirname(f)) for f in got.inputFiles()} == {"shard=3", "shard=4"}
    assert tables.read_range(spark, path, "id", 5000, 6000).count() == 0


def test_shards_cost_no_tasks_of_their_own_and_both_writers_agree(spark, tmp_path, monkeypatch):
    from .test_growth import shuffled

    k = F.col("id")
    day = F.timestamp_seconds(k * 977)
    df = spark.range(900).select(
        F.when(k % 50 > 0, day).alias("at"), "id", (k / 8).cast("decimal(20,3)").alias("d"), F.encode(k.cast("string"), "UTF-8").alias("raw"), F.when(k % 3 > 0, F.concat(F.lit("é"), k)).alias("s"),
        F.array(k, F.lit(None)).alias("xs"), F.struct(k.alias("a"), F.date_add(F.lit("2000-02-28").cast("date"), k.cast("int")).alias("b")).alias("st"), (k % 2 > 0).alias("odd"), (k % 100).cast("tinyint").alias("t"),
    )
    a, b = f"file://{tmp_path}/a", str(tmp_path / "b")
    manifest = []
    n = shuffled(spark, lambda: manifest.extend(tables.write_shards(df, a, ["at"], 3).collect()), "numCompleteTasks")
    monkeypatch.setattr(tables, "GROUP_BYTES", 1)
    with pytest.raises(ValueError, match="exists"):
        tables.write_shards(df, a, ["at"], 3)
    monkeypatch.setattr(tables, "_local", lambda spark, path: None)
    other: list = []
    m = shuffled(spark, lambda: other.extend(tables.write_shards(df, b, ["at"], 3).collect()), "numCompleteTasks")
    assert n < 100 and m > 300  # Spark's writer lists each folder in a task
    by = lambda r: r.shard
    assert sorted(other, key=by) == sorted(manifest, key=by) and len(manifest) == 300
    assert {r.n_rows for r in manifest} == {3} and min(r.shard for r in manifest if r.first_key is None) == 1
    rows = lambda path: spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, number long, shard long").parquet(path)
    of = lambda path: sorted((r for r in rows(path).filter("shard is not null").collect()), key=lambda r: r.number)
    assert of(a) == of(b) and len(of(a)) == 900
    low, high = F.timestamp_seconds(F.lit(97_000)), F.timestamp_seconds(F.lit(107_000))
    assert sorted(r.id for r in tables.read_range(spark, a, "at", low, high).collect()) == [i for i in range(900) if i % 50 and 97_000 <= i * 977 <= 107_000]


def test_rows_are_shuffled_twice_and_keys_of_files_once_for_all(spark, tmp_path, monkeypatch):
    from .test_growth import shuffled

    k = F.col("id")
    key = F.when(k % 40 == 0, None).when(k % 41 == 0, float("nan")).otherwise((k * 7 % 500 - 250) / 4)
    df = spark.range(5000).select(key.alias("k"), F.sha2(k.cast("string"), 256).alias("s"))
    rank = lambda r: (r.k is not None, r.k != r.k, r.k if r.k == r.k and r.k is not None else 0, r.s)
    parts = [p[i : i + 100] for p in [sorted(df.collect(), key=rank)] for i in range(0, 5000, 100)]
    want = [repr((i + 1, 100, *((known[0].k, known[-1].k) if (known := [r for r in p if r.k is not None]) else (None, None)))) for i, p in enumerate(parts)]
    got: list = []
    n = shuffled(spark, lambda: got.extend(tables.write_shards(df, str(tmp_path / "a"), ["k"], 100, range_rows=450).collect()))
    assert [repr(tuple(r)) for r in sorted(got, key=lambda r: r.shard)] == want
    assert {i: list(map(repr, p)) for i, p in files(str(tmp_path / "a"), spark).items()} == {i + 1: [repr(tuple(r)) for r in p] for i, p in enumerate(parts)}
    assert n < 10_500  # 15 000 and more, as ranges were shuffled again to be numbered
    assert [r.number for r in sorted(tables.numbered(df, ["k"], 450).collect(), key=rank)] == [*range(1, 5001)]
    monkeypatch.setattr(tables, "_local", lambda spark, path: None)
    tables.write_shards(df, str(tmp_path / "b"), ["k"], 100, range_rows=450)
    assert sorted(repr(tuple(r)) for r in spark.read.parquet(str(tmp_path / "b/_manifest")).collect()) == sorted(want)


def test_a_task_that_writes_shards_holds_a_row_group_and_may_run_again(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(tables, "GROUP_BYTES", 100)
    batches = [pa.RecordBatch.from_pydict({"k": [*range(i, i + 20)], "shard": [1 + x // 70 for x in range(i, i + 20)]}) for i in range(0, 140, 20)]
    run = tables._shard_files(str(tmp_path), "k")
    for _ in range(2):
        got = [tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()]
        assert got == [(1 + k // 70, k) for k in range(140)]
        assert sorted(os.listdir(tmp_path / "shard=1")) == ["part-000000001.zstd.parquet"]
    assert pq.ParquetFile(tmp_path / "shard=1" / "part-000000001.zstd.parquet").num_row_groups == 4
    with pytest.raises(ValueError, match="shard 1 came after 2"):
        list(run(iter([batches[5], batches[0]])))
    assert not [f for d in os.listdir(tmp_path) for f in os.listdir(tmp_path / d) if f.startswith(".")]


def test_years_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "y")
    first = spark.createDataFrame([("1999", i) for i in range(5)] + [("2000", i) for i in range(7)], "PYEAR string, v int")
    got = tables.write_years(first, path, (1999, 2001))
    assert sorted(map(tuple, got.collect())) == [(1999, 5, 5, True), (2000, 7, 7, True)]
    again = spark.createDataFrame([("2000", 1), (None, 2)], "PYEAR string, v int")
    got = tables.write_years(again, path, (1999, 2001)).filter("source_rows > 0")
    assert {r.PYEAR: tuple(r)[1:] for r in got.collect()} == {2000: (1, 1, True), None: (1, 1, True)}
    assert spark.read.parquet(path).groupBy("PYEAR").count().orderBy("PYEAR").collect() == [(None, 1), (1999, 5), (2000, 1)]


def test_only_what_was_checked_is_published(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    with pytest.raises(ValueError, match="nothing is published"):
        tables.read_published(spark, path)
    tables.publish(spark.range(3), path, {"negative": F.col("id") < 0})
    with pytest.raises(ValueError, match="negative: 2"):
        tables.publish(spark.range(-2, 3), path, {"negative": F.col("id") < 0})
    repeated = lambda df: df.groupBy("id").count().filter("count > 1").agg(F.lit("repeated").alias("rule"), F.count("*").alias("n_violations"))
    with pytest.raises(ValueError, match="repeated: 3"):
        tables.publish(spark.range(3).union(spark.range(3)), path, {}, repeated)
    assert tables.read_published(spark, path).count() == 3
    assert len([d for d in os.listdir(tmp_path / "p") if d.startswith("version-")]) == 1  # failed ones are gone
    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)

    def changed(staged):  # the input changes between the write and the check
        spark.range(-9, 0).write.mode("append").parquet(source)
        return repeated(staged)

    tables.publish(spark.read.parquet(source), path, {"negative": F.col("id") < 0}, changed)
    assert sorted(r.id for r in tables.read_published(spark, path).collect()) == [*range(5)]


def test_lines_with_wrong_fields_are_counted(spark, tmp_path):
    from tripleloom.sources.files import good_lines, line_account, read_raw_csv

    path = str(tmp_path / "raw.csv")
    with open(path, "w") as f:
        f.write('"1","a, b","x"\n"2",\\N,"y"\n"3","too few"\n"4","a","b","too many"\n"5","say \\"so\\"","z"\n')
    raw = read_raw_csv(spark, path, ["i", "t", "u"], "bad")
    assert sorted(map(tuple, good_lines(raw, "bad").collect()), key=repr) == [("1", "a, b", "x"), ("2", None, "y"), ("5", 'say "so"', "z")]
    assert tuple(line_account(raw, "bad").first()) == (5, 3, 2, 0, '"3","too few"', 0.4)
