"""A store of text vectors: each text is encoded once for each encoder."""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .semantic import DIMENSIONS, Encoder

# Encoders of this module travel whole with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts of a task's range of lengths.
RANGE_TEXTS = 100_000


def trigram_encoder(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A deterministic encoder: counts of character trigrams of the padded text, in buckets by their md5."""
    def one(text: str) -> list[float]:
        padded, out = f"  {text.lower()}  ", [0.0] * DIMENSIONS
        for i in range(len(padded) - 2):
            out[int(hashlib.md5(padded[i : i + 3].encode()).hexdigest()[:7], 16) % DIMENSIONS] += 1
        return out

    for frame in frames:
        yield pd.DataFrame({"text": frame["text"], "vector": [one(t) for t in frame["text"]]})


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def encoders(spark: SparkSession, store: str) -> dict[str, dict]:
    """What is known of the store's encoders: name to dimensions and settings (a row for each)."""
    if not _exists(spark, f"{store}/_encoders"):
        return {}
    return {r["name"]: {"dimensions": r["dimensions"]} | json.loads(r["settings"]) for r in spark.read.parquet(f"{store}/_encoders").collect()}


def add_texts(texts: DataFrame, store: str, name: str, encoder: Encoder, dimensions: int, run: int = 1, settings: dict | None = None, text_col: str = "text") -> int:
    """Encode the distinct texts that the store lacks for this encoder, and add them; returns how many those were.

    New texts are found by an anti join.  They are dealt to ranges of
    similar length and sorted, so an Arrow batch pads little, and encoded once; nulls are left out.
    A name stands for one encoder: other dimensions or settings are an error.
    """
    spark = texts.sparkSession
    wanted = {"dimensions": dimensions} | (settings or {})
    known = encoders(spark, store)
    if known.get(name, wanted) != wanted:
        raise ValueError(f"encoder {name} is {known[name]} in the store, not {wanted}")
    new = texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    path = f"{store}/encoder={name}"
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select("text"), "text", "left_anti")
    ranges = max(1, math.ceil(new.count() / RANGE_TEXTS))
    dealt = new.withColumn("n", F.length("text")).repartitionByRange(ranges, "n", "text").sortWithinPartitions("n", "text").select("text")
    seen = Observation()
    made = dealt.mapInPandas(encoder, "text string, vector array<double>")
    right = F.size("vector") == dimensions
    made = made.withColumn("vector", F.when(right, F.col("vector")).otherwise(F.raise_error(F.lit(f"{name} gave a vector that hasn't {dimensions} numbers")))).withColumn("run", F.lit(run))
    made.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    if name not in known:
        spark.createDataFrame([(name, dimensions, json.dumps(settings or {}))], "name string, dimensions int, settings string").write.mode("append").parquet(f"{store}/_encoders")
    return seen.get["n"]


def vectors(spark: SparkSession, store: str, name: str) -> DataFrame:
    """``text, vector, run``: a row for each text of the encoder, with the run that encoded it."""
    return spark.read.parquet(f"{store}/encoder={name}")
