"""Periodic runs of words, by recompression.

The words of a text are numbered.  A *run* is a stretch that no neighbouring
word extends, whose smallest period ``q`` fits in it four times or more.

1. Candidates: for each period ``p``, the places 0, p, 2p, ... form a grid, and
   all grids together have n ln n places.  A run of period p holds four places of
   its grid in a row, so four equal words there are a candidate.
2. A run-length grammar of the text, made by recompression: block compression
   turns maximal repetitions of a symbol into one symbol, pair compression splits
   the symbols by a bit of their hash and turns each left one followed by a right one into
   one symbol; both alternate until few symbols are left.  Equal symbols of a
   level have equal expansions, and equal stretches are cut alike but for
   their ends.
3. The longest common extension of two places to the right (left) climbs to the
   highest level where equal symbols begin (end) at both, jumps over them, and goes on;
   where blocks of one symbol differ in length it jumps over the shorter one.
4. A candidate is extended both ways by such queries; what has a smaller
   period was found at that period before.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, texts_of

#: Places of grids that are looked at at a time.
GRID = 1 << 22
_WHITE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def words_of(text: str) -> list[str]:
    """The stretches without ASCII white space."""
    return [w for w in text.translate(_WHITE).split(" ") if w]


class Grammar:
    """A sequence of numbers, level by level: symbols, the places where they begin, base symbol and count of blocks."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = len(symbols)
        now, starts = np.unique(symbols, return_inverse=True)[1], np.arange(self.n)
        self._keep(now, starts, now, np.ones(self.n, np.int64))
        while len(now) > 1:
            now, starts = self._blocks(now, starts)
            if len(now) > 1:
                now, starts = self._pairs(now, starts)

    def _keep(self, symbols, starts, base, times) -> None:
        self.levels.append((symbols, np.append(starts, self.n), base, times))

    def _blocks(self, now, starts):
        first = np.flatnonzero(np.append(True, now[1:] != now[:-1]))
        if len(first) == len(now):
            return now, starts
        times = np.diff(np.append(first, len(now)))
        base = now[first]
        names = np.unique(base * (int(times.max()) + 1) + times, return_inverse=True)[1]
        self._keep(names, starts[first], base, times)
        return names, starts[first]

    def _pairs(self, now, starts):
        """No two neighbours are equal; each half of all pairs goes with the side of the symbols that joins more of them."""
        seed = np.uint64(2 * len(self.levels) + 1)
        h = (now.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * seed
        side = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(1) == 0
        falls, rises = side[:-1] & ~side[1:], ~side[:-1] & side[1:]
        joined = falls if falls.sum() >= rises.sum() else rises
        if not joined.any():  # few symbols that fell on one side: the least one against the others
            side = now == now.min()
            falls, rises = side[:-1] & ~side[1:], ~side[:-1] & side[1:]
            joined = falls if falls.sum() >= rises.sum() else rises
        second = np.append(False, joined)
        first = np.flatnonzero(~second)
        after = np.where(np.append(joined, False), np.append(now[1:], 0) + 1, 0)[first]
        names = np.unique(now[first] * (int(now.max()) + 2) + after, return_inverse=True)[1]
        self._keep(names, starts[first], names, np.ones(len(names), np.int64))
        return names, starts[first]

    def _jump(self, level: int, i: int, j: int, back: bool) -> int:
        """How far equal symbols (or the shorter of two blocks) reach that begin, or end, at both places; 0: not at all, -1: no symbols begin at both."""
        symbols, starts, base, times = self._lists(level)
        a, b = bisect_left(starts, i), bisect_left(starts, j)
        if a == len(starts) or b == len(starts) or starts[a] != i or starts[b] != j:
            return -1
        if back:
            a, b = a - 1, b - 1
            if a < 0 or b < 0:
                return 0
        elif a == len(symbols) or b == len(symbols):
            return 0
        if symbols[a] == symbols[b]:
            return starts[a + 1] - starts[a]
        if base[a] == base[b] and times[a] != times[b]:
            k = min(times[a], times[b])
            return (starts[a + 1] - starts[a]) // times[a] * k
        return 0

    def _lists(self, level: int):
        kept = self.levels[level]
        if isinstance(kept[0], np.ndarray):  # plain lists answer single questions faster
            kept = self.levels[level] = tuple(x.tolist() for x in kept)
        return kept

    def extension(self, i: int, j: int, back: bool = False) -> int:
        """How many symbols from ``i`` and ``j`` on (or up to them, ``back``) are equal."""
        got = level = 0
        while True:
            here = (i - got, j - got) if back else (i + got, j + got)
            best, at = self._jump(level, *here, back), level
            while best > 0 and at + 1 < len(self.levels):  # climb
                more = self._jump(at + 1, *here, back)
                if more < 0 or more < best:
                    break
                best, at = more, at + 1
            while best <= 0 and at > 0:  # descend
                at -= 1
                best = self._jump(at, *here, back)
            if best <= 0:
                return got
            got, level = got + best, at


def _candidates(symbols: np.ndarray):
    """Arrays of (periods, places) with four equal words on the grid from there on, by period and place; periods of a batch are less than twice its first."""
    n = len(symbols)
    p = 1
    while 4 * p <= n:
        upto, size = p, 0
        while 4 * upto <= n and upto < 2 * p and (not size or size + n // upto <= GRID):
            size += n // upto
            upto += 1
        periods = np.arange(p, upto)
        count = np.maximum((n - 3 * periods - 1) // periods + 1, 0)  # i + 3p < n
        each = np.repeat(periods, count)
        at = (np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)) * each
        for k in (1, 2, 3):
            same = symbols[at] == symbols[at + k * each]
            each, at = each[same], at[same]
        yield each, at
        p = upto


def find_runs(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and period."""
    grammar = None
    runs: list[tuple[int, int, int]] = []
    for each, at in _candidates(symbols):
        if len(each):
            for start, n, q in runs:  # stretches of a smaller period are known
                if len(each) and n > 3 * each[0]:
                    new = (each % q != 0) | (at < start) | (at + 3 * each >= start + n)
                    each, at = each[new], at[new]
        period, upto = 0, 0
        for p, i in zip(each.tolist(), at.tolist(), strict=True):
            if p != period:
                period, upto = p, 0
            if i < upto:
                continue
            grammar = grammar or Grammar(symbols)
            end = i + p + grammar.extension(i, i + p)
            start = i - grammar.extension(i, i + p, back=True)
            upto = end - p  # later places of the grid up to here belong to the same stretch
            if end - start >= max(6, 4 * p) and not any(p % q == 0 and s <= start and end <= s + n for s, n, q in runs):
                runs.append((start, end - start, p))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run repeats: a run keeps its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        gone[start + q] += 1
        gone[start + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def _found(batches):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            found, kept = [], []
            for text in texts_of(batch.column(1), at):
                words = words_of(text)
                number: dict[str, int] = {}
                runs = find_runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                kept.append(" ".join(collapsed(words, runs) if runs else words))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE), pa.array(found, pa.list_(run)), pa.array(kept, pa.string())], ["id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, runs array<struct<start, length, period>>, collapsed string)`` for each row.

    Runs have at least six words and four periods, and stand by start and
    period; the collapsed text keeps the first period of each, its words one
    space apart.  Null and empty texts have no runs and an empty collapsed text.
    Null and repeated ids are rows of their own, and equal texts have equal runs.
    A long text is one row: its work is n ln n comparisons of arrays and
    some queries a run, its memory some numbers a word.  No rows give none;
    other columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_found, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").withColumnRenamed("id", id_col)
