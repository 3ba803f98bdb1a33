"""Near-duplicate groups against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from tripleloom.llm import near_dedup
from tripleloom.llm.components import components


def brute(texts: dict[int, str | None], size: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def corpus() -> dict[int, str | None]:
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(400)}"
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(80)]
    texts: dict[int, str | None] = {}
    for i in range(60):  # near copies, some of them too far from each other
        text = list(base)
        for _ in range(rnd.choice((1, 3, 6))):
            text[rnd.randrange(len(text))] = word()
        texts[i] = " ".join(text)
    for i in range(60, 110):  # a shared passage
        texts[i] = " ".join([*(word() for _ in range(rnd.choice((5, 40)))), *passage])
    for i in range(110, 130):  # exact copies
        texts[i] = "Same Text\tof few words" if i % 2 else "same text of FEW words"
    short = ["a b c d e f", "a b c d e", "a b c d e f g", "one", "One", "", None, " \n", "x y", "x  y", "É é", "é é"]
    texts.update(dict(enumerate(short, 130)))
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 0, i) for i, t in texts.items()], "doc_id long, text string, n long, node long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle_words=size).collect()}
    assert got == brute(texts, size)


def test_one_of_each_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand here now"), (None, "a b c d e f g"), (4, None)], "doc_id long, text string")
    kept = near_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
