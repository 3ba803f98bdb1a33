"""Benchmark decontamination with spaced-seed hashing.

Fixed masks hash some positions of every token window and ignore the others,
so a substituted word spoils only the seeds that look at it.  All masks look at
the same four positions, so a window whose four tokens stand like that in no
benchmark window has no seed in common with it: one hash a position, looked up
in the benchmark's, leaves few positions to make seeds of.  Their seeds meet the
benchmark's with the tokens around them; there the texts are aligned and their
equal tokens counted.  Items shorter than the longest mask have seeds of
neighbouring words instead: the whole item, or its halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, narrow, stash

#: Positions of 1 are hashed, those of 0 ignored.
MASKS = ("11101011", "110010111", "1101100101")
#: Positions that every mask hashes.
COMMON = tuple(j for j in range(min(map(len, MASKS))) if all(m[j] == "1" for m in MASKS))
#: Words of the shortest and of the longest mask, and of the longest item without a mask.
SHORTEST, LONGEST = min(map(len, MASKS)), max(map(len, MASKS))
SHORT_ITEM = LONGEST - 1
#: Seeds that may be broadcast: a seed has at most some 40 numbers, so they are below 40 MB.
FEW_SEEDS = 100_000
#: Tokens that the alignment takes on either side of a hit.
REACH = 5


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words without ASCII punctuation."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]+", "")
    return F.transform(F.filter(F.split(plain, r"[\x09-\x0D\x20]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _hashed(tokens: Column, i: Column, offsets, tag: int) -> Column:
    return F.xxhash64(F.lit(tag), *[F.get(tokens, i + j) for j in offsets])


def _mask_seeds(tokens: Column, i: Column) -> Column:
    """``(span, seed)`` of each mask at a position."""
    return F.array(*[F.struct(F.lit(len(m)).alias("span"), _hashed(tokens, i, [j for j, bit in enumerate(m) if bit == "1"], k).alias("seed")) for k, m in enumerate(MASKS)])


def _run_seeds(tokens: Column, i: Column, spans) -> Column:
    """``(span, seed)`` of runs of neighbouring words at a position."""
    return F.array(*[F.struct(F.lit(n).alias("span"), _hashed(tokens, i, range(n), -n).alias("seed")) for n in spans])


def _key(tokens: Column, i: Column) -> Column:
    return _hashed(tokens, i, COMMON, -1)


def benchmark_seeds(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``seed, span, run, item, before, piece, key``: each seed with its surroundings.

    ``piece`` has the item's tokens from REACH before the window to REACH after
    it; ``before`` of them stand before it.  ``run`` tells seeds of
    neighbouring words.  Items with masks have the seeds of all windows; of
    items of up to SHORT_ITEM words those of up to four have one seed, of all
    words, and longer ones one of each half, so that one substituted word
    leaves one of them whole.  Items without words have none.
    """
    items = benchmark.select(F.col(item_col).alias("item"), token_hashes(F.col(text_col)).alias("t")).filter("size(t) > 0")
    n, t = F.size("t"), F.col("t")
    windows = items.filter(n >= SHORTEST).select("item", "t", F.explode(F.sequence(F.lit(0), n - SHORTEST)).alias("i"))
    masked = windows.select("item", "t", "i", F.explode(_mask_seeds(t, F.col("i"))).alias("s"), F.lit(False).alias("run")).filter(F.col("i") + F.col("s.span") <= n)
    first = F.when(n <= 4, n).otherwise(F.ceil(n / 2)).cast("int")
    halves = F.filter(F.array(F.struct(F.lit(0).alias("i"), first.alias("n")), F.struct(first.alias("i"), (n - first).alias("n"))), lambda x: x["n"] > 0)
    short = items.filter(n <= SHORT_ITEM).select("item", "t", F.explode(halves).alias("h")).select("item", "t", "h.i", "h.n")
    runs = short.select("item", "t", "i", F.explode(F.filter(_run_seeds(t, F.col("i"), range(1, SHORT_ITEM // 2 + 2)), lambda s: s["span"] == F.col("n"))).alias("s"), F.lit(True).alias("run"))
    start = F.greatest(F.col("i") - REACH, F.lit(0))
    whole = masked.union(runs).withColumn("start", start)
    return whole.select("s.seed", "s.span", "run", "item", (F.col("i") - F.col("start")).alias("before"), F.slice("t", F.col("start") + 1, F.col("i") - F.col("start") + F.col("s.span") + REACH).alias("piece"), _key(t, F.col("i")).alias("key")).distinct()


def _around(tokens: DataFrame, seeds) -> DataFrame:
    """``id, lead, around, s``: seeds of positions with the tokens around, ``lead`` of which stand before."""
    lead = F.least(F.col("i"), F.lit(REACH))
    kept = tokens.select("id", lead.alias("lead"), F.slice("d", F.col("i") - lead + 1, F.lit(2 * REACH + LONGEST)).alias("around"))
    return kept.select("id", "lead", "around", F.explode(seeds(F.col("around"), F.col("lead"))).alias("s"))


def _candidates(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """``id, d, i``: positions whose key is one of the benchmark's."""
    key = F.xxhash64(F.lit(-1), F.col("w"), *[F.get("d", F.col("i") + j) for j in COMMON[1:]])
    placed = tokens.select("id", "d", F.posexplode("d").alias("i", "w")).filter(F.col("i") + SHORTEST <= F.size("d")).withColumn("key", key)
    if keys.count() <= SMALL_ROWS:
        return placed.join(F.broadcast(keys), "key", "left_semi")
    # many keys meet narrow rows in a shuffle, positions go back to their texts
    found = placed.select("id", "i", "key").join(keys, "key", "left_semi").groupBy("id").agg(F.collect_set("i").alias("at"))
    return tokens.join(found, "id").select("id", "d", F.explode("at").alias("i"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", share: float = 0.8) -> DataFrame:
    """One row for each id that holds a benchmark passage: id, ``n_items``,
    ``first_item`` (the smallest), ``matched`` (most equal tokens around a hit).

    A hit counts if at least ``share`` of the item's tokens around it (all that
    the item has within REACH tokens of the seed's window) equal the aligned
    tokens of the document.  Null and empty texts hold nothing, very long ones
    are searched whole; rows without an id aren't reported; rows that repeat an
    id are reported once.  Items that repeat a text are all found.  An empty
    benchmark finds nothing.  Other columns are ignored, whatever their names.
    """
    seeds = stash(benchmark_seeds(benchmark, item_col))
    n = seeds.count()
    tokens = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), token_hashes(F.col(text_col)).alias("d"))
    placed = _around(_candidates(tokens, stash(seeds.filter("not run").select("key").distinct())), _mask_seeds)
    spans = sorted(r["span"] for r in seeds.filter("run").select("span").distinct().collect())  # as many as masks and halves have lengths
    if spans:
        runs = _around(tokens.select("id", "d", F.explode(F.sequence(F.lit(0), F.size("d") - 1)).alias("i")).filter("i < size(d)"), lambda d, i: _run_seeds(d, i, spans))
        placed = placed.union(runs)
    met = placed.select("id", "lead", "around", "s.seed", "s.span").join(F.broadcast(seeds) if n <= FEW_SEEDS else seeds, ["seed", "span"])
    at = lambda j: F.col("lead") - F.col("before") + j
    equal = F.size(F.filter(F.transform("piece", lambda w, j: (F.get("around", at(j)) == w) & (at(j) >= 0)), lambda x: x))
    hits = met.select("id", "item", equal.alias("matched"), F.size("piece").alias("length")).filter(F.col("matched") >= share * F.col("length"))
    found = hits.groupBy("id", "item").agg(F.max("matched").alias("matched"))
    return found.groupBy("id").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"), F.max("matched").alias("matched")).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id isn't :func:`contaminated`."""
    found = stash(contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias("__found_id")))
    return docs.join(narrow(found), docs[id_col] == F.col("__found_id"), "left_anti")
