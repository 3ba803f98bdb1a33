"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

1. One pass over the texts hashes the word shingles of each document; a
   document's *sketch* is the ``k`` smallest values of its set.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Inverted lists of retained values generate the overlaps.  The key of a list
   is a run of three neighbouring retained values (two for small sets): two
   sets with a Jaccard similarity of 0.8 share no run of three among 48
   retained values with a probability of 3e-8, while one shared passage or
   some frequent word pairs seldom fill a run, so lists stay short.
4. In each list every member is compared with the first and the last one,
   which is linear in the list.  Components of the links found so far tell
   which lists still join several components; members of different
   components are then compared with each other, all of them.  Short lists do
   that by a join; long ones are cut into blocks, and each pair of blocks
   counts its intersections at once and gives nothing but its links.  No list
   is capped.
5. A pair goes on if the union sketch estimates a similarity not more than
   five standard deviations below the threshold, and is a link if the exact
   similarity of the full sets reaches it.
6. Components over the links.

Nothing but counters reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, join_narrow, narrow as _narrow, stash, texts_of
from .components import components

_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)
#: Sets of up to SMALL_MAX shingles are listed by runs of two, sets of at least
#: LARGE_MIN by runs of three; 0.8 * SMALL_MAX > LARGE_MIN, so that two linked
#: sets always have one kind in common.
SMALL_MAX, LARGE_MIN = 16, 10
#: Lists of up to FEW members are compared by a join, longer ones in blocks; by the same rule.
FEW = 40
#: Shingles that the partners in one part of a hub have together, and those of a block of a long list.
HUB_VALUES, BLOCK_VALUES = 100_000, 1_000_000


class _WordHash(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _M1
    h = (h ^ (h >> _SHIFT)) * _M2
    return h ^ (h >> _SHIFT)


def shingle_hashes(text: str, size: int, words: dict) -> np.ndarray:
    """The sorted distinct signed hashes of a text's ``size``-word shingles."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for j in range(span):
        out = _mix(out * _STEP + h[j : len(h) - span + 1 + j])
    return np.unique(out.view(np.int64))


def _signatures(size: int, k: int):
    def run(batches):
        words = _WordHash()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                n, h1, h2, sketch = [], [], [], []
                for text in texts_of(batch.column(1), start):
                    s = shingle_hashes(text, size, words)
                    u = s.view(np.uint64)
                    n.append(len(s))
                    h1.append(int(_mix(u).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    h2.append(int(np.bitwise_xor.reduce(_mix(u + _STEP)).view(np.int64)) if len(s) else 0)
                    sketch.append(s[:k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, SLICE), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))],
                    ["id", "n", "h1", "h2", "sketch"],
                )

    return run


def _full_sets(size: int):
    def run(batches):
        words = _WordHash()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                sets = [shingle_hashes(t, size, words) for t in texts_of(batch.column(1), start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, SLICE), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return run


def _keys(n: Column, s: Column) -> Column:
    """The keys of the inverted lists that a set enters."""
    at = lambda i, d: F.element_at(s, (i + d).cast("int"))
    empty = F.array().cast("array<bigint>")
    two = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.xxhash64(F.lit(2), at(i, 0), at(i, 1)))
    three = F.transform(F.sequence(F.lit(1), F.size(s) - 2), lambda i: F.xxhash64(F.lit(3), at(i, 0), at(i, 1), at(i, 2)))
    return F.concat(F.when((n >= 4) & (n <= SMALL_MAX), two).otherwise(empty), F.when(n >= LARGE_MIN, three).otherwise(empty))


def least_shared(k: int, threshold: float) -> int:
    """How many of the ``k`` least values of a union both sets must hold: at a
    similarity of ``threshold`` fewer are shared with a probability below 4e-8."""
    tail = 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if tail >= 4e-8:
            return c
    return k


def _fits(threshold: float) -> Column:
    """Whether the sizes allow a link."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * round(100 * threshold)


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b, n_b`` of pairs whose sizes allow a link and whose union sketch
    doesn't rule it out; sketches that hold the whole sets are exact."""
    pairs = stash(pairs)
    sketches = join_narrow(sketches, stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_fits(threshold))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    likely = F.when(F.size(union) < k, shared * 100 >= F.size(union) * round(100 * threshold)).otherwise(shared >= least_shared(k, threshold))
    return both.filter(likely).select("a", "b", "n_b")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0


def _links_of_block(threshold: float):
    """Links between different parts among the rows of a pair of blocks."""
    least = round(100 * threshold)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, part, n = group["node"].to_numpy(), group["part"].to_numpy(), group["s"].map(len).to_numpy()
        rows = np.repeat(np.arange(len(n)), n)
        _, value, df = np.unique(np.concatenate(list(group["s"])), return_inverse=True, return_counts=True)
        holders = rows[np.argsort(value, kind="stable")]  # of each value, one after another
        end = np.cumsum(df)
        start, at, found = end - df, np.cumsum(n) - n, []
        for i in range(len(n)):
            mine = value[at[i] : at[i] + n[i]]
            mine = mine[df[mine] > 1]
            if not len(mine):
                continue
            shared = np.bincount(np.concatenate([holders[start[v] : end[v]] for v in mine]), minlength=len(n))
            linked = (100 * shared >= least * (n[i] + n - shared)) & (part != part[i]) & (node > node[i])
            found += [(node[i], node[j]) for j in np.flatnonzero(linked)]
        return pd.DataFrame(found, columns=["u", "v"])

    return run


def _links_in_long_lists(rows: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links between all pairs of different parts in each list, a task for each
    pair of its blocks of about BLOCK_VALUES shingles."""
    kind = texts.schema["node"].dataType
    nodes = stash(rows.select("node").distinct())
    sets = join_narrow(texts, nodes, "node", "left_semi").mapInArrow(_full_sets(size), T.StructType([T.StructField("node", kind), T.StructField("s", T.ArrayType(T.LongType()))]))
    sets = stash(sets.dropDuplicates(["node"]), nodes)
    blocks = F.ceil(F.col("values") / BLOCK_VALUES)
    block = F.pmod(F.xxhash64("node"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    dealt = join_narrow(sets, stash(rows.select("key", "node", "n", "part", F.explode(pairs).alias("b"))), "node")
    return dealt.groupBy("key", "b").applyInPandas(_links_of_block(threshold), T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def _links_of_hubs(size: int, threshold: float):
    """Links of rows ``hub, part, second, node, text``: the hub's own row stands before those of its partners."""
    least = round(100 * threshold)

    def run(batches):
        words, last, own = _WordHash(), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                hubs, parts, seconds, nodes = (batch.column(c).slice(start, SLICE).to_pylist() for c in range(4))
                u, v = [], []
                for hub, part, second, node, text in zip(hubs, parts, seconds, nodes, texts_of(batch.column(4), start), strict=True):
                    if (hub, part, second, node) == last:  # a repeated id
                        continue
                    last = (hub, part, second, node)
                    s = shingle_hashes(text, size, words)
                    if not second:
                        own = s
                        continue
                    shared = _shared(own, s)
                    if shared * 100 >= (len(own) + len(s) - shared) * least:
                        u.append(hub)
                        v.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(u, batch.column(0).type), pa.array(v, batch.column(0).type)], ["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs ``a, b, n_b`` whose full sets have a Jaccard similarity of at least ``threshold``.

    Texts travel, which are smaller than their sets, to the parts of ``a``:
    each of about HUB_VALUES shingles of its partners.  A task holds one set
    of a hub and one of a partner at a time.
    """
    hubs = stash(pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / HUB_VALUES).alias("parts")))
    placed = join_narrow(pairs, hubs, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    seconds = placed.select("hub", "part", F.lit(True).alias("second"), F.col("b").alias("node"))
    firsts = placed.select("hub", "part").distinct().select("hub", "part", F.lit(False).alias("second"), F.col("hub").alias("node"))
    wanted = stash(firsts.union(seconds))
    sent = join_narrow(texts, wanted, "node").select("hub", "part", "second", "node", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "second", "node")
    kind = texts.schema["node"].dataType
    return sent.mapInArrow(_links_of_hubs(size, threshold), T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, k: int = 48) -> DataFrame:
    """One row per input row: the id under its own name, ``n_shingles``,
    ``component_id`` (least id that links lead to, itself included) and
    ``kept`` (the id is its component's).

    Words are runs of anything but ASCII white space, A-Z lower-cased; with
    fewer than ``shingle_words`` words the whole sequence is the only shingle.
    Null, empty and blank texts have no shingles, are linked with nothing and
    are kept.  Rows that repeat a text are one class.  A row without an id
    takes part in no class and has a null component and ``kept`` true.  Rows
    that repeat an id are all returned; they count as one document.  Other
    columns are ignored, whatever their names.  No rows give no rows, very long
    texts are read whole.  ``threshold`` is taken to two decimals, and 0.8 is the least for which the
    lists' miss probability holds.
    """
    return _near_duplicates(docs, id_col, text_col, shingle_words, threshold, k)[0]


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, k: int = 48) -> tuple[DataFrame, list[DataFrame]]:
    """:func:`near_duplicates` and the stashes that its result reads."""
    if threshold < 0.8:
        raise ValueError("runs of retained values find similarities of 0.8 or more")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "h1", "h2")), T.StructField("sketch", T.ArrayType(T.LongType()))])
    signed = stash(docs.mapInArrow(_signatures(shingle_words, k), schema))

    real = signed.filter("n > 0 and id is not null")
    repeated = stash(real.groupBy("n", "h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"))
    known = join_narrow(signed, repeated, ["n", "h1", "h2"], "left").withColumn("node", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("first", "id")).otherwise(F.col("id")))
    rows = known.select("id", "n", "node")
    sketches = known.filter("n >= 4 and id = node").select("node", "n", "sketch")

    entries = sketches.select("node", "n", F.explode(_keys(F.col("n"), F.col("sketch"))).alias("key"))
    lists = stash(entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("lo <> hi"))
    # lists with the same members need one look only
    lists = stash(lists.groupBy("size", "members", "lo", "hi").agg(F.min("key").alias("key")))
    members = stash(join_narrow(entries, stash(lists.filter("size > 2").select("key", "lo", "hi")), "key"))

    stars = members.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.a", "p.b")
    pairs = stars.filter("a <> b").union(lists.filter("size = 2").select("lo", "hi")).distinct()
    texts = docs.filter("id is not null").select(F.col("id").alias("node"), "text")
    links = stash(_verified(stash(_estimated(pairs, sketches, k, threshold)), texts, shingle_words, threshold))
    found = stash(components(links))

    placed = join_narrow(members, found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"))
    split = stash(placed.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("values"), F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("key", "c", "values"))
    open_rows = stash(join_narrow(placed, split, "key"), members, split)
    few = open_rows.filter(F.col("c") <= FEW)
    left = few.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("p_a"))
    right = few.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("p_b"))
    rest = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("p_a") != F.col("p_b")) & _fits(threshold))
    rest = stash(rest.select("a", "b", "n_b").distinct())
    more = _verified(rest, texts, shingle_words, threshold).union(_links_in_long_lists(open_rows.filter(F.col("c") > FEW), texts, shingle_words, threshold))
    joined = stash(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), links, found, rest, open_rows)

    out = rows.join(joined.withColumnRenamed("component", "part"), "node", "left").withColumn("component_id", F.coalesce("part", "node"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), [signed, repeated, joined]


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps.

    Of rows that repeat an id only one stays, any of them; rows without an id
    all stay.  Other columns may have any names but ``__id``.
    """
    found, read = _near_duplicates(docs, id_col, **options)
    per = found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    per = stash(per.filter("not __kept or __n > 1"), *read)
    left = docs.join(_narrow(per), docs[id_col] == F.col("__id"), "left_anti")
    repeated = stash(per.filter("__kept"))
    if repeated.isEmpty():
        return left
    return left.union(docs.join(_narrow(repeated), docs[id_col] == F.col("__id"), "left_semi").dropDuplicates([id_col]))  # only their rows are shuffled
