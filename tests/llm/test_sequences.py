"""Runs of words, byte-pair encoding and conversation repair against brute force."""

from __future__ import annotations

import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import bpe, queries, repair, runs

TOKENIZER = queries.TOKENIZER
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary here")


def plain_runs(x: list) -> list[tuple[int, int, int]]:
    out = []
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(6, 4 * p) and not any(all(x[a] == x[a + q] for a in range(i, i + n - q)) for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_and_extensions():
    rnd = random.Random(3)
    for _ in range(800):
        m, x = rnd.choice([1, 2, 2, 3, 8]), []
        while len(x) < rnd.randrange(1, 80):
            x += [rnd.randrange(m) for _ in range(rnd.randrange(1, 7))] * rnd.choice([1, 1, 2, 4, 5, 9])
        assert runs.find_runs(np.array(x, np.int64)) == plain_runs(x)
        grammar = runs.Grammar(np.array(x, np.int64))
        i, j = rnd.randrange(len(x)), rnd.randrange(len(x))
        if i != j:
            assert grammar.extension(i, j) == next(k for k in itertools.count() if max(i, j) + k >= len(x) or x[i + k] != x[j + k])
            assert grammar.extension(i, j, back=True) == next(k for k in itertools.count() if min(i, j) - k <= 0 or x[i - k - 1] != x[j - k - 1])


def test_runs_of_long_texts():
    began = time.time()
    assert runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs.find_runs(np.concatenate([np.arange(3000)] * 100)) == [(0, 300_000, 3000)]
    assert time.time() - began < 30


def test_runs_of_rows(spark):
    text = "x a b a b a b a b y"
    df = spark.createDataFrame([(1, text, "z"), (1, text, "z"), (None, " \t", "z"), (2, None, "z"), (3, "a a a a a", None), (4, "a\na a\ta a a", "z")], "doc_id long, text string, runs string")
    got = sorted(runs.periodic_runs(df).collect(), key=lambda r: (r.doc_id or 0, r.collapsed))
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(None, [], ""), (1, [(1, 8, 2)], "x a b y"), (1, [(1, 8, 2)], "x a b y"), (2, [], ""), (3, [], "a a a a a"), (4, [(0, 6, 1)], "a")]
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_repeating_words(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 30))) for i in range(200)]
    got = dict(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", queries._repeating(F.col("doc_id"), F.col("text"))).collect())
    import zlib

    for i, text in rows:
        h, w = zlib.crc32(str(i).encode()), text.split()
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        assert got[i].split() == w


@needs_tokenizer
def test_bpe_by_chunks(spark, monkeypatch):
    from tokenizers import Tokenizer

    slow, rnd = Tokenizer.from_file(TOKENIZER), random.Random(1)
    with open(TOKENIZER, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    for name, value in (("LEAST", 4), ("MEAN", 8), ("STRETCH", 40)):
        monkeypatch.setattr(bpe, name, value)
    bits = ["word", "é", "日本", " ", "  ", "\n", " \n\t", "'s", "<|endoftext|>", "<|endo", "12", "3.4", "...", "　", "\x1c", "\xa0", "🙂", "A", "the quick brown", " I'll go"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(60))) for _ in range(400)]
    for text in texts:
        chunks = [(at, len(c.decode()), vocabulary.encode(c.decode())) for at, c in bpe._chunks(text)]
        assert sum(n for _, n, _ in chunks) == len(text)
        ids = slow.encode(text, add_special_tokens=False).ids
        assert bpe.assemble(text, [c for c in chunks if rnd.random() < 0.6], vocabulary).tolist() == ids
        assert vocabulary.decode(np.array(ids, np.int32)) == slow.decode(ids, skip_special_tokens=False)
    rows = [*enumerate(texts), *enumerate(texts[:50]), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, k1 long")
    for few in (bpe.SMALL_ROWS, 0):  # texts with shared chunks by a broadcast of their keys, or all of them by a join
        monkeypatch.setattr(bpe, "SMALL_ROWS", few)
        got = [(r.doc_id, r.ids, r.decoded) for r in bpe.encode(df, TOKENIZER).collect()]
        want = [(i, slow.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode(df.limit(0), TOKENIZER).collect() == []


@needs_tokenizer
def test_bpe_of_long_texts():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    began = time.time()
    for text in (" " * 300_000, "a" * 300_000, " \n" * 100_000 + "x", "ab " * 100_000):
        assert bpe.assemble(text, [], vocabulary).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert time.time() - began < 30


def plain_repair(turns: str) -> tuple[int, str]:
    """All edits of a few turns, with up to two insertions anywhere."""
    best = None
    gaps = ["", "I", "II"]
    for edits in itertools.product(*["DKR" if t != "D" else "D" for t in turns]):
        for inserted in itertools.product(gaps, repeat=len(turns) + 1):
            audit = "".join(i + e for i, e in zip(inserted, [*edits, ""], strict=True))
            cost = sum(repair.COST[e] for e in audit) + sum(t.isupper() and e != "D" for t, e in zip(turns, edits, strict=True))
            if best and (cost, audit) >= best:
                continue
            marks = iter(turns)
            roles = "".join("." if e == "I" else next(marks).lower() if e == "K" else next(marks) and "." if e == "R" else next(marks) and "" for e in audit)
            if any(re.fullmatch("(s?(ua)+)?", "".join(free)) for free in itertools.product(*["ua" if c == "." else c for c in roles])):
                best = cost, audit
    return best


def glr(turns: str) -> tuple[int, str]:
    return repair.finish({s: (cost, audit, audit) for s, (cost, audit) in repair.paths(turns, 0).items()})[:2]


def test_repair_against_all_edits():
    for n in range(4):
        for turns in itertools.product("DsuaxSUAX", repeat=n):
            assert glr("".join(turns)) == plain_repair("".join(turns)), turns


def test_repaired_roles():
    rows = [("system", "s"), ("assistant", "b"), ("x", ""), ("user", "c")]
    assert repair.apply(rows, "KIKDKI") == [("system", "s"), ("user", ""), ("assistant", "b"), ("user", "c"), ("assistant", "")]
    assert glr("") == (0, "") and repair.apply([], "") == []


def by_plain_rules(rows: list[tuple]) -> dict:
    """The results of conversations, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            end = text.strip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            token = role[:1] if role[:1] in ("s", "u", "a") else "x"
            turns += "D" if fault in ("blank", "duplicate") else token.upper() if fault else token
        numbers = [r[0] for r in own if r[0] is not None]
        gaps = numbers[-1] - numbers[0] + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = glr(turns)
        lines = "\n".join(":".join(r) for r in repair.apply([r[1:] for r in own], audit))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, lines)
    return out


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repair_of_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rnd = random.Random(block)
    texts = ["One.", "Two!", "cut", "", " \n", "Three? ", "x" * 50 + "."]
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7]), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", "tool", "", " "]), rnd.choice(texts)) for _ in range(200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, id int, times string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    assert got == by_plain_rules(rows)
    nothing = spark.createDataFrame([(8, None, None, None)], df.select("conv_id", "turn", "role", "text").schema)
    assert [tuple(r) for r in repair.repair_conversations(nothing).collect()] == [(8, 0, 1, 0, 0, 0, 3, "D", "")]
    assert repair.repair_conversations(df.limit(0)).collect() == []
