"""Toxicity scores of text restored by a noisy-channel model.

*Restoring.*  Spans that look disguised (digits or signs inside words, letters
set apart, letters drawn out) become a lattice of what each character may stand
for: itself, a letter that it imitates, or nothing.  A Viterbi search picks the
likeliest reading under a character trigram model counted over all documents.

*Scoring.*  Words and word beginnings of labelled documents whose share of toxic
documents stands out are the terms of a logistic model; a document's score
comes from the terms of its text with the restored words added.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, sampled, stash, texts_of

#: What a sign may imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¥": "y", "§": "s"}
#: Accented letters as the language model counts them.
ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
ANY_LETTER, GAPS = "*#", " .-_~'*/\\,"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs in nats: of an imitation, of a masked letter, of leaving out a gap, of leaving out a repeated letter (by its place in the run).
IMITATE, MASKED, GAP, REPEAT_SECOND, REPEAT_LATER = 1.0, 3.0, 0.3, 6.0, 0.1

#: Characters of a span whose choices are held at a time.
_BLOCK = 1024

#: The log odds of a text with one term that is enough by itself.
SURE = 3.0

_RUN, _DRAWN = re.compile(r"\w+"), re.compile(r"([^\W\d_])\1\1")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_~*/,]{1,2}[^\W_](?![^\W_])){2,}")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_EDGES = ".,;:?\"'()[]{}<>#%&*=~^`/\\-_"
#: Those of them that imitate no letter.
_ENDS = "".join(c for c in _EDGES if c not in IMITATES)


def _letter_table() -> np.ndarray:
    """Of each code point below 0x250, the letter it counts as (1 to 26) or 0; the last entry is for all others."""
    letters = [chr(c).lower()[:1].translate(ACCENTS) for c in range(0x250)]
    return np.array([ord(x) - 96 if x and x in LETTERS else 0 for x in letters] + [0], np.int64)


_TABLE = _letter_table()


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(text: str) -> np.ndarray:
    """Letters as 1 to 26, all else as 0."""
    return _TABLE[np.minimum(_raw(text), 0x250)]


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``cell, n``: letter trigrams of all texts, 27 signs each, at most 19 683 rows.

    Null and empty texts add nothing.
    """
    def run(batches):
        for batch in batches:
            total = np.zeros(27**3, np.int64)
            for start in range(0, batch.num_rows, SLICE):
                # two blanks before each text and one after it
                c = _codes("  " + "   ".join(t for t in texts_of(batch.column(0), start) if t) + " ")
                cells = (c[:-2] * 27 + c[1:-1]) * 27 + c[2:]
                total += np.bincount(cells[(c[1:-1] > 0) | (c[2:] > 0)], minlength=27**3)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Costs, -log p(c | a, b), of 27 x 27 x 27 trigrams, interpolated with bigrams and single letters."""
    tri = np.zeros(27**3)
    for row in counts.collect():  # bounded by the alphabet
        tri[row["cell"]] = row["n"]
    tri = tri.reshape(27, 27, 27)
    one = tri.sum((0, 1)) + 1
    two = (tri.sum(0) + 5 * (one / one.sum())) / (tri.sum((0, 2))[:, None] + 5)
    return -np.log((tri + 20 * two[None]) / (tri.sum(2)[..., None] + 20))


def _options(span: str) -> list[tuple[list[tuple[int, float]], bool, float | None, bool]]:
    """For each character: the letters it may be read as with their prices,
    whether it may be any, the price of leaving it out (None: it can't be), and
    whether it is a gap."""
    out, run, previous = [], 0, ""
    for ch in span.lower():
        run = run + 1 if ch == previous else 1
        previous = ch
        letter = ch.translate(ACCENTS)
        read = [(ord(letter) - 96, 0.0)] if letter in LETTERS else []
        read += [(ord(x) - 96, IMITATE + 0.3 * k) for k, x in enumerate(IMITATES.get(ch, ""))]
        gap = ch in GAPS or ch in ANY_LETTER
        # the first of a run is always read, so what repeats it may be left out
        drop = GAP if gap else (REPEAT_SECOND if run == 2 else REPEAT_LATER) if run > 1 and read else None if read else 1.0
        out.append((read, ch in ANY_LETTER, drop, ch in GAPS))
    return out


def decode(span: str, cost: np.ndarray, boundaries: bool = False) -> str:
    """The likeliest reading of ``span``; with ``boundaries`` a gap may also be
    read as a blank, so that the reading may be several words.

    States are the last two letters read, all of them are kept: 27 x 27 at
    most.  The work is linear in the length of the span.
    """
    # what a character may be read as here: letters with their prices, whether any letter, the price of leaving it out, whether a blank
    lattice = [(tuple(read), any_letter, drop, gap and boundaries) for read, any_letter, drop, gap in _options(span)]
    codes = _decode_dense(lattice, cost) if any(o[1] for o in lattice) else _decode_few(lattice, cost)
    return "".join(chr(96 + code) if code else " " for code in codes)


def _decode_few(lattice: list[tuple], cost: np.ndarray) -> list[int]:
    """Without signs for any letter few states are alive at a time; a dict holds them."""
    beam: dict = {(0, 0): (0.0, None)}
    for read, _, drop, blank in lattice:
        later: dict = {}
        for (a, b), (spent, back) in beam.items():
            for code, price in [*read, (0, 0.0)] if blank and b else read:
                total, key = spent + price + cost[a, b, code], (b, code)
                if key not in later or total < later[key][0]:
                    later[key] = (total, (back, code))
            if drop is not None:
                total, key = spent + drop, (a, b)
                if key not in later or total < later[key][0]:
                    later[key] = (total, back)
        beam = later
    best = min(beam.items(), key=lambda kv: kv[1][0] + cost[kv[0][0], kv[0][1], 0])
    letters, back = [], best[1][1]
    while back is not None:
        back, code = back
        letters.append(code)
    return letters[::-1]


def _decode_dense(lattice: list[tuple], cost: np.ndarray) -> list[int]:
    """With them nearly all states are alive; arrays of all 27 x 27 hold them.

    Only the costs at the start of each block of characters are kept, and a
    block's choices are made again on the way back, so memory grows by some 6 bytes a
    character.
    """
    by_last = np.ascontiguousarray(cost.transpose(1, 2, 0))  # of (b, c, a)
    spent = np.full((27, 27), np.inf)
    spent[0, 0] = 0.0
    starts = []
    for start in range(0, len(lattice), _BLOCK):
        starts.append(spent)
        spent, _ = _walk(spent, lattice[start : start + _BLOCK], by_last, keep=False)
    a, b = divmod(int((spent + cost[:, :, 0]).argmin()), 27)
    letters = []
    for k in range(len(starts) - 1, -1, -1):
        _, choices = _walk(starts[k], lattice[k * _BLOCK : (k + 1) * _BLOCK], by_last, keep=True)
        for came in reversed(choices):
            if came is not None and came[a, b] >= 0:
                letters.append(b)
                a, b = int(came[a, b]), a
    return letters[::-1]


def _walk(spent: np.ndarray, lattice: list[tuple], by_last: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Costs of the states after a block, and for each of its characters the
    letter before last of each state's best way there: -1 where the character
    is left out, None where it is in all states.

    Once leaving a character out is best in all states, costs differ by a
    constant only, so it is best for the like of it until another is read.
    """
    choices, settled = [], set()
    for options in lattice:
        read, any_letter, drop, blank = options
        if options in settled:
            spent = spent + drop
            choices.append(None)
            continue
        later, came = np.full((27, 27), np.inf), np.full((27, 27), -1, np.int8)
        before = np.ascontiguousarray(spent.T)  # of (b, a)
        if any_letter:
            total = before[:, None, :] + by_last[:, 1:, :]
            came[:, 1:] = total.argmin(2)
            later[:, 1:] = total.min(2) + MASKED
        for code, price in [*read, (0, 0.0)] if blank else read:
            total = before + by_last[:, code, :]
            if code == 0:
                total[0] = np.inf  # no blank after a blank
            least = total.min(1) + price
            better = least < later[:, code]
            later[better, code], came[better, code] = least[better], total.argmin(1)[better]
        if drop is not None:
            left = spent + drop
            better = left <= later
            later[better], came[better] = left[better], -1
            if better.all():
                settled.add(options)
            else:
                settled.clear()
        else:
            settled.clear()
        spent = later
        choices.append(came if keep else None)
    return spent, choices


def readings(span: str, cost: np.ndarray) -> set[str]:
    """What a span may say: as one word, and as several if it has gaps."""
    out = {decode(span, cost)}
    if any(c in GAPS for c in span):
        out.update(decode(span, cost, boundaries=True).split())
    return out


def _drawn(text: str) -> list[str]:
    """Words in which a letter stands three times in a row."""
    raw = _raw(text)
    same = raw[1:] == raw[:-1]
    if len(raw) < 3 or not (same[1:] & same[:-1] & (raw[2:] >= 65)).any():
        return []
    return [m[0] for m in _RUN.finditer(text) if _DRAWN.search(m[0])]


def _apart(text: str, tokens: list[str]) -> list[str]:
    """Runs of three and more letters set apart by blanks or signs."""
    short = np.fromiter(map(len, tokens), np.int64, len(tokens)) <= 2
    three = np.flatnonzero(short[2:] & short[1:-1] & short[:-2]) if len(tokens) > 2 else ()
    alone = [len(t) == 1 or not t[1].isalnum() for k in three for t in tokens[k : k + 3]] if len(three) else []
    if any(all(alone[k : k + 3]) for k in range(0, len(alone), 3)):
        return [m[0] for m in _APART.finditer(text)]
    return []


def scanned(text: str) -> tuple[set[str], list[str], list[str]]:
    """The lower-cased words of a text, its spans that may hide another word,
    and its words with signs at their ends, which may be letters or not."""
    tokens = text.split()
    words, spans, signed = set(), [], []
    for token in set(tokens):
        core = token.strip(_EDGES)
        whole = token.strip(_ENDS)
        if core.isalpha():
            words.add(core.lower())
        elif core:
            words.update(_WORD.findall(core.lower()))
            bare = core.rstrip("!$@+|")
            if any(c.isalpha() for c in core):
                if len(core) > 2 and not bare.replace("'", "").replace("’", "").isalpha():
                    spans.append(core)
                    if bare != core and len(bare) > 2:
                        spans.append(bare)
                    spans += [m[0] for m in _APART.finditer(core)]
                elif bare != core and len(core) > 2:
                    signed.append(core)
        if len(whole) > len(core) and len(whole) > 2 and any(c.isalpha() for c in core):
            signed.append(whole)
    return words, spans + _drawn(text) + _apart(text, tokens), signed


def disguised(text: str) -> list[str]:
    """Spans of ``text`` that may hide a word, apart from words with signs at their ends."""
    return scanned(text)[1]


def restored_words(text: str, cost: np.ndarray, known: dict[str, set[str]]) -> set[str]:
    """The words of a text, lower-cased, and what its disguised spans and its
    words with signs at their ends decode to.

    ``known`` remembers decoded spans.
    """
    words, spans, signed = scanned(text)
    for span in spans + signed:
        if span not in known:
            if len(known) > 50_000:
                known.clear()
            known[span] = readings(span, cost)
        words |= known[span]
    return words


def terms_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of four and five letters of longer ones."""
    out = set(words)
    out.update("^" + w[:4] for w in words if len(w) > 4)
    out.update("^" + w[:5] for w in words if len(w) > 5)
    return out


class ToxicityModel:
    """Costs of the language model and the weights of terms; small enough to travel with each task."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], bias: float):
        self.cost, self.weights, self.bias = cost, weights, bias
        self.words = {t for t in weights if t[0] != "^"}
        self.four, self.five = ({t[1:] for t in weights if t[0] == "^" and len(t) == n} for n in (5, 6))

    def score(self, text: str, known: dict[str, set[str]]) -> float:
        words = restored_words(text, self.cost, known)
        hits = words & self.words
        hits |= {"^" + w[:4] for w in words if w[:4] in self.four and len(w) > 4}
        hits |= {"^" + w[:5] for w in words if w[:5] in self.five and len(w) > 5}
        z = self.bias + sum(self.weights[t] for t in sorted(hits))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _fit_weights(hits: list[tuple[int, list[int]]], size: int, steps: int = 400, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 terms by Adam."""
    y = np.array([h[0] for h in hits], float)
    row = np.repeat(np.arange(len(hits)), [len(h[1]) for h in hits])
    col = np.concatenate([np.array(h[1], np.int64) for h in hits]) if len(row) else np.empty(0, np.int64)
    p = np.zeros(size + 1)
    rate = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    p[size] = math.log(rate / (1 - rate))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        z = p[size] + np.bincount(row, p[col], len(hits))
        d = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(col, d[row], size), d.sum()) + l2 * np.append(p[:size], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return p[:size], float(p[size])


def _least_share(y: int, n: int, z: float = 1.645) -> float:
    """The lower Wilson bound of a share."""
    p = y / n
    return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 40_000) -> ToxicityModel:
    """A model from documents and the labels of some of them.

    Every text counts for the language model.  At most about ``max_rows``
    labelled documents, chosen by a hash of the id, teach the weights; every
    term of theirs that stands out gets one.  Null labels are left out, of several
    labels of an id the largest counts.  Without labels every score is that of
    the bias.
    """
    cost = language_model(character_counts(docs, text_col))
    labels = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = sampled(labels, "toxic", max_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # bounded by max_rows
    words = stash(sample.select("y", "text").mapInArrow(_word_lists(cost), "y int, terms array<string>"))

    totals = words.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, positive = totals["n"] or 0, totals["y"] or 0
    base = positive / n if n else 0.0
    counted = words.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("y")).filter("y >= 4")
    z = (F.col("y") - F.col("n") * base) / F.sqrt(F.col("n") * max(base * (1 - base), 1e-9))
    best = counted.filter((F.col("y") > 1.5 * base * F.col("n")) & (z > 4)).orderBy("term").collect()  # bounded by max_rows
    terms = [r["term"] for r in best]
    index = {t: i for i, t in enumerate(terms)}

    def found(batches):
        for batch in batches:
            lists = [[index[t] for t in ts if t in index] for ts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["y", "hits"])

    hits = [(r["y"], r["hits"]) for r in words.mapInArrow(found, "y int, hits array<long>").collect()]  # bounded by max_rows
    hits.sort()
    weights, bias = _fit_weights(hits, len(terms))
    # a term that the regression needs and that is hardly ever innocent is enough by itself
    for k, r in enumerate(best):
        if weights[k] > 1.5 and _least_share(r["y"], r["n"]) > 0.85:
            weights[k] = max(weights[k], SURE - bias)
    return ToxicityModel(cost, {t: float(w) for t, w in zip(terms, weights, strict=True) if abs(w) > 1e-3}, bias)


def _word_lists(cost: np.ndarray):
    def run(batches):
        known: dict[str, set[str]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                lists = [sorted(terms_of(restored_words(t, cost, known))) for t in texts_of(batch.column(1), start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, SLICE), pa.array(lists, pa.list_(pa.string()))], ["y", "terms"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``score`` (0 to 1) of the whole text.

    Null and empty texts get the score of the bias; very long ones are read
    whole, in time linear in their length.  Repeated rows and ties score alike,
    other columns are ignored, no rows give no rows.
    """
    known_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known: dict[str, set[str]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                scores = [model.score(t, known) for t in texts_of(batch.column(1), start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, SLICE), pa.array(scores, pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {known_type}, score double")
