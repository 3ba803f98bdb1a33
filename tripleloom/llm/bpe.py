"""Byte-level BPE encoding that reuses content-defined chunks.

1. A rolling hash over the bytes of each text cuts it into chunks whose ends
   depend on the bytes around them only, so passages that texts share have
   chunks in common wherever they stand.
2. Chunks that occur more than once in the corpus are encoded once.
3. Each text is put together from the ids of its shared chunks and of the
   stretches between them.  Ids around a join aren't those of the whole text,
   so a window around it is encoded anew; it grows until its ids agree with
   those of both neighbours beside the join.
4. Ids are decoded by the bytes of their tokens.

Why agreement is exact: the pattern that splits texts before merging never
puts what stands before white space and the white space itself into one piece,
and what it does between two such places depends on the text between them.  So
equal text between two such places has equal ids in any surroundings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import SMALL_ROWS, narrow, stash

#: Fixed value: the pattern of byte-level pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a chunk: at least, on average beyond that (a power of two), at most.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Characters of a stretch that is encoded at a time, and of the texts whose ids are held at a time.
STRETCH, HELD = 1 << 16, 1 << 22
_GEAR = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
_BLANKS = " \t\n\r"


class Vocabulary:
    """A byte-level BPE vocabulary out of a tokenizer's JSON file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        split = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level BPE vocabulary without normalisation or prefix is needed")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(c in s for s in special for c in _BLANKS):
            raise ValueError("special tokens with white space would cross the places where texts may be cut")
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]  # bytes that are written as themselves
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        made = [ranks[bytes(of[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("merges must be in the order of their ids")
        self.special, self._bpe = special, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._slow = Tokenizer.from_str(text)
        self._slow.no_truncation()
        self._slow.no_padding()
        tokens = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self._starts = np.cumsum(self.sizes) - self.sizes
        self._bytes = np.frombuffer(b"".join(parts), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        try:
            ids = self._bpe.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its pattern gives up on enormous stretches of white space
            ids = self._slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self._starts[ids] - first, sizes) + np.arange(int(sizes.sum()))
        return self._bytes[at].tobytes().decode("utf-8", "replace")


def cut(raw: np.ndarray) -> list[int]:
    """The ends of a text's chunks, in bytes; each follows a whole character."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):  # the hash of the 32 bytes up to each place
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    whole = np.append((raw[1:] & 0xC0) != 0x80, True)
    marks = np.flatnonzero(((h >> np.uint64(20)) & np.uint64(MEAN - 1) == 0) & whole) + 1
    ends, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = int(marks[i]) if i < len(marks) else n
        if end - at > MOST:
            end = at + MOST
            while end < n and not whole[end - 1]:
                end -= 1
        ends.append(min(end, n))
        at = ends[-1]
    if at < n:
        ends.append(n)
    return ends


def _chunks(text: str) -> Iterator[tuple[int, bytes]]:
    """The chunks of a text, with the character where each begins."""
    data = text.encode("utf-8")
    at = begin = 0
    for end in cut(np.frombuffer(data, np.uint8)):
        chunk = data[begin:end]
        yield at, chunk
        at, begin = at + len(chunk.decode("utf-8")), end


def _signed(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _places(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = {c: [] for c in ("k1", "k2", "at", "n", "h1", "h2")}
            for k1, k2, text in zip(*(batch.column(c).slice(start, 256).to_pylist() for c in range(3)), strict=True):
                for at, chunk in _chunks(text):
                    h1, h2 = _signed(xxhash.xxh3_128_intdigest(chunk))
                    for c, v in zip(rows.values(), (k1, k2, at, len(chunk.decode("utf-8")), h1, h2), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))


def _chunk_texts(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            found = [(*_signed(xxhash.xxh3_128_intdigest(c)), c) for t in batch.column(0).slice(start, 256).to_pylist() for _, c in _chunks(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h1", "h2", "chunk"])


def _encoded(spec: str):
    def run(batches):
        vocabulary = Vocabulary(spec)
        for batch in batches:
            ids = [vocabulary.encode(c.decode("utf-8")).tobytes() for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["h1", "h2", "ids"])

    return run


def _borders(text: str, lo: int, hi: int, step: int, most: int) -> list[int]:
    """Up to ``most`` places in (lo, hi) where white space follows something else, from one end on."""
    out: list[int] = []
    for p in range(lo + 1, hi) if step > 0 else range(hi - 1, lo, -1):
        if text[p] in _BLANKS and not text[p - 1].isspace():
            out.append(p)
            if len(out) == most:
                break
    return out


class _Piece:
    """A stretch of a text with ids; ``index`` is the token that begins at a place, None if none does."""

    def __init__(self, text: str, start: int, end: int, ids: np.ndarray, sizes: np.ndarray):
        self.text, self.start, self.end, self.ids, self.whole = text, start, end, ids, False
        self.ends = np.concatenate([[0], np.cumsum(sizes[ids])])

    def index(self, place: int) -> int | None:
        offset = len(self.text[self.start : place].encode("utf-8"))
        i = int(np.searchsorted(self.ends, offset))
        return i if i < len(self.ends) and self.ends[i] == offset else None


def assemble(text: str, shared: list[tuple[int, int, np.ndarray]], vocabulary: Vocabulary) -> np.ndarray:
    """The ids of ``text``, given those of some chunks as (first character, characters, ids)."""
    pieces, at = [], 0
    for start, n, ids in [*sorted(shared, key=lambda s: s[0]), (len(text), 0, None)]:
        for a in range(at, start, STRETCH):
            pieces.append((a, min(start, a + STRETCH), None))
        if n:
            pieces.append((start, start + n, ids))
        at = start + n
    if not pieces:
        return np.empty(0, np.int32)
    done: list[np.ndarray] = []
    left, i = None, 0
    while i < len(pieces):
        start, end, ids = pieces[i]
        i += 1
        while left and left.whole and i < len(pieces) and end - start < left.end - left.start:  # no place to cut: double, so that work stays linear but for a logarithm
            end, ids, i = pieces[i][1], None, i + 1
        right = _Piece(text, start, end, vocabulary.encode(text[start:end]) if ids is None else ids, vocabulary.sizes)
        left = right if left is None else _joined(text, left, right, vocabulary, done)
    done.append(left.ids)
    return np.concatenate(done)


def _joined(text: str, left: _Piece, right: _Piece, vocabulary: Vocabulary, done: list[np.ndarray]) -> _Piece:
    """Hand over ids of ``left`` that are certain, and return the rest of it with ``right``."""
    width = 2
    while True:
        before, after = _borders(text, left.start, left.end, -1, width), _borders(text, right.start - 1, right.end, 1, width)
        a = before[-1] if len(before) == width else left.start
        b = after[-1] if len(after) == width else right.end
        i = left.index(a)
        j = right.index(b)
        if i is not None and j is not None:
            middle = _Piece(text, a, b, vocabulary.encode(text[a:b]), vocabulary.sizes)
            if _agree(left, middle, a, before[-2] if a != left.start else a) and _agree(middle, right, after[-2] if b != right.end else b, b):
                done.append(left.ids[:i])
                rest = _Piece(text, a, right.end, np.concatenate([middle.ids, right.ids[j:]]), vocabulary.sizes)
                rest.whole = a == left.start and b == right.end
                return rest
        width *= 2


def _agree(x: _Piece, y: _Piece, a: int, b: int) -> bool:
    """Both have the same ids between two places; there is nothing to compare at an end that is certain."""
    if a == b:
        return True
    i, j, k, m = x.index(a), x.index(b), y.index(a), y.index(b)
    return None not in (i, j, k, m) and np.array_equal(x.ids[i:j], y.ids[k:m])


def _finished(spec: str):
    def run(batches):
        vocabulary = Vocabulary(spec)

        def packed(first, ids):
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays([first, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array([vocabulary.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

        for batch in batches:
            start, size, ids, last = 0, 0, [], (None, None)
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                if text != last[0]:  # copies stand together after the join
                    shared = batch.column(2)[row].as_py() or [] if batch.num_columns > 2 else []
                    last = (text, assemble(text, [(s["at"], s["n"], np.frombuffer(s["ids"], np.int32)) for s in shared], vocabulary))
                ids.append(last[1])
                size += len(text)
                if size > HELD:
                    yield packed(batch.column(0).slice(start, len(ids)), ids)
                    start, size, ids = start + len(ids), 0, []
            yield packed(batch.column(0).slice(start, len(ids)), ids)

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>, decoded string)`` for each row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE vocabulary, read by the driver
    and sent with the tasks (some megabytes).  Strings of special tokens become
    their ids.  A null text counts as empty and has no ids; null and repeated ids
    are rows of their own; copies get the same ids.  Very long texts are encoded in
    stretches of STRETCH characters, with joins mended in the same way, so that memory
    is that of their ids.  No rows give none; other columns, whatever their names, are left out.

    Only texts that hold a shared chunk move: they meet their chunks' ids in one
    shuffle; the others are encoded where they are read, as long as the keys of
    the former (16 bytes each) are few enough for a broadcast.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    Vocabulary(spec)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("again"), text).alias("k2"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, ids array<int>, decoded string"

    places = stash(rows.select("k1", "k2", "text").mapInArrow(_places, "k1 long, k2 long, at long, n long, h1 long, h2 long"))
    repeated = stash(places.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").select("h1", "h2"))
    known = narrow(repeated)
    texts = rows.select("text").mapInArrow(_chunk_texts, "h1 long, h2 long, chunk binary").join(known, ["h1", "h2"]).distinct()
    encoded = stash(texts.mapInArrow(_encoded(spec), "h1 long, h2 long, ids binary"))
    shared = stash(places.join(known, ["h1", "h2"]).distinct(), places)
    keys = stash(shared.select("k1", "k2").distinct(), repeated)
    lists = shared.join(encoded, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n", "ids")).alias("shared"))
    moving, staying = rows, None
    if keys.count() <= SMALL_ROWS:
        few = F.broadcast(keys)
        moving, staying = rows.join(few, ["k1", "k2"], "left_semi"), rows.join(few, ["k1", "k2"], "left_anti")
    done = moving.join(lists, ["k1", "k2"], "left").select("id", "text", "shared").mapInArrow(_finished(spec), out)
    if staying is not None:
        done = done.union(staying.select("id", "text").mapInArrow(_finished(spec), out))
    return done.withColumnRenamed("id", id_col)
