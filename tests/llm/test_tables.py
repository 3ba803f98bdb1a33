"""URL filter, decontamination, mixing, preference pairs, media and the pipeline on hand-made cases."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripleloom.llm import decontaminate, media, mixing, preference, url_reputation
from tripleloom.llm.queries import RULES


def test_hosts_and_rules(spark):
    urls = ["HTTP://Www.Example.COM/en/1?x", "http://example.com/en/", "https://a.net/es/2#t", "x.com/en/", None, "http://b.org", "http://É.example.com/en/x", "http://notexample.com/en/", "http://com/", "http://u:p@c.co.uk:80/z"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, none, RULES).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("net/es/", "block") and got[7][2:] == ("com/", "allow")
    assert got[3][:3] == got[4][:3] == ("", "", None)
    assert got[5] == ("b.org", "", None, got[5][3]) and got[6][0] == "É.example.com" and got[8][2] == "com/"
    assert url_reputation.judge_urls(pages.limit(0), none, RULES).count() == 0


def test_reputation_shrinks_to_the_domain(spark):
    rows = [("good.a.org", 1)] * 60 + [("good.a.org", 0)] * 2 + [("new.a.org", None)] + [("bad.b.org", 0)] * 50 + [("one.b.org", 1)] + [("x.c.co.uk", 1)] * 3
    out = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert out["good.a.org"].verdict == "allow" and out["bad.b.org"].verdict == "block" == out["one.b.org"].verdict
    assert out["one.b.org"].mean < out["new.a.org"].mean and out["x.c.co.uk"].domain == "c.co.uk"


def test_substitutions_are_tolerated(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    item = rnd.choices(words, k=40)
    wrong = [w if k % 11 else "zzz" for k, w in enumerate(item)]
    scattered = list(item)
    rnd.shuffle(scattered)
    noise = lambda n: rnd.choices(words, k=n)
    docs = {1: noise(50) + item + noise(50), 2: noise(20) + wrong + noise(20), 3: noise(30) + item[5:30] + noise(30), 4: noise(200), 5: scattered, 6: item[:6] + noise(60)}
    df = spark.createDataFrame([(i, " ".join(w).title()) for i, w in docs.items()] + [(7, None), (8, ""), (1, " ".join(item)), (None, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, ", ".join(item)), (10, "too short"), (11, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.first_item) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {1: (1, 9), 2: (1, 9), 3: (1, 9)}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "7", "8", "None"] and kept.columns == df.columns


def test_blocks_of_seeds_find_the_same(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, item), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    whole = decontaminate.contaminated(df, bench).collect()
    monkeypatch.setattr(decontaminate, "FEW_SEEDS", 10)
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", 10)
    assert len(whole) == 1 and decontaminate.contaminated(df, bench).collect() == whole


def test_short_items_are_found(spark):
    """Whole up to four words; of five to nine words any one may differ."""
    words = [f"w{k}" for k in range(9)]
    docs, items, want = [], [], set()
    for n in range(1, 10):
        item = [f"{w}n{n}" for w in words[:n]]
        items.append((n, " ".join(item)))
        docs.append((100 * n, " ".join(["x", "y", *item, "z"])))
        want.add((100 * n, n))
        for k in range(n):
            docs.append((100 * n + k + 1, " ".join(["x", *item[:k], "other", *item[k + 1 :], "z"])))
            if n >= 5:
                want.add((100 * n + k + 1, n))
    docs.append((1, "w0n5 w1n5 nothing w3n5 else w5n5"))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.first_item) for r in found.collect()} == want


def test_clashing_names_in_documents(spark):
    item = " ".join(f"w{k}" for k in range(30))
    names = ["seed", "key", "i", "d", "w", "lead", "around", "item", "s", "span", "run", "id", "item_id"]
    df = spark.createDataFrame([(1, item, *names), (2, "nothing of it", *names)], ["doc_id", "text", *names])
    bench = spark.createDataFrame([(5, item, "x")], "item_id long, text string, seed string")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2]


def test_counts_invert_the_poisson_distribution(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", f"t{i}", i) for i in range(4000)] + [(9000, None, None, 1)], "doc_id long, source string, text string, copy long")
    rates = {r.source: r.rate for r in mixing.replication_rates(docs).collect()}
    assert rates["a"] < 1 < rates["b"] and rates[""] == 4.0
    got: dict = {}
    for r in mixing.mix_sources(docs).select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    for i in range(0, 4000, 7):
        rate = rates["a" if i % 4 else "b"]
        u = int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while u >= total:
            k += 1
            p *= rate / k
            total += p
        assert got.get(i, 0) == k
    n = {s: sum(c for i, c in got.items() if i < 4000 and (i % 4 != 0) == (s == "a")) for s in "ab"}
    assert abs(n["a"] / n["b"] - 1) < 0.15
    only = mixing.mix_sources(docs, {"b": 2.0})
    assert {r.source for r in only.select("source").distinct().collect()} == {"b"}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_common_prefix_and_masks(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    shared = t(("system", "S"), ("user", "Hi"))
    rows = [(1, shared + t(("assistant", "yes")), shared + t(("assistant", "no"), ("user", None))), (2, shared, shared), (3, None, t(("assistant", "x"))), (4, t((None, None)), t((None, None), ("assistant", "z")))]
    df = spark.createDataFrame(rows, f"id long, chosen {preference.TURNS}, rejected {preference.TURNS}")
    out = {r.id: r for r in preference.format_preferences(df).collect()}
    a = out[1]
    assert a.n_prompt_turns == 2 and a.prompt == "<|system|>\nS<|end|>\n<|user|>\nHi<|end|>\n" and a.chosen == "<|assistant|>\nyes<|end|>\n" and a.usable
    start, end = map(int, a.chosen_mask.split(":"))
    assert a.chosen[start:end] == "yes<|end|>" and a.rejected[slice(*map(int, a.rejected_mask.split(":")))] == "no<|end|>"
    assert (out[2].n_prompt_turns, out[2].chosen, out[2].usable) == (2, "", False)
    assert (out[3].n_prompt_turns, out[3].chosen_mask, out[3].rejected_mask) == (0, "", "14:22") and out[4].n_prompt_turns == 1


def png(w: int = 2) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(w + 1))) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(24) + bytes(4)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
ZIP = b"PK\x03\x04data" + b"PK\x01\x02" + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 4, 8, 0)


@pytest.mark.parametrize("value,kind", [(png(), "image/png"), (GIF, "image/gif"), (BMP, "image/bmp"), (JPEG, "image/jpeg"), (ZIP, "application/zip"), (b"%PDF-1.4 startxref 0 %%EOF", "application/pdf")])
def test_formats(value, kind):
    signs = media.automaton()
    assert media.located(value, signs) == [(0, len(value), kind)]
    assert media.located(b"junk" + value + b"tail", signs) == [(4, len(value), kind)]
    assert media.located(value[:-1] if kind != "application/pdf" else value[:-3], signs) == []


def test_sniffing_corrects_and_carves(spark):
    rows = [(1, png(), "image/jpeg"), (2, b"text " + GIF + b".." + png(9), "text/plain"), (3, None, None), (4, b"BM no picture", "image/bmp")]
    sniffed = media.sniff(spark.createDataFrame(rows, "id long, media binary, declared string"))
    out = {r.id: r for r in sniffed.collect()}
    assert (out[1].type, out[1].corrected) == ("image/png", True)
    assert [(e.id, e.type, bytes(e.bytes)) for e in media.carved(sniffed).orderBy("offset").collect()] == [(2, "image/gif", GIF), (2, "image/png", png(9))]
    assert (out[3].type, out[3].length, out[3].embedded) == ("application/octet-stream", 0, []) and out[4].corrected


def test_wave_round_trip(spark):
    texts = ["", None, "é" * 96, "x" * 193, "RIFF GIF89a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", "text", media.payload_of(F.col("text")).alias("p")).withColumn("media", media.as_wav(F.col("p"))).withColumn("declared", F.lit("audio/wav"))
    out = media.sniff(df).withColumn("back", media.wav_samples(F.col("media"))).collect()
    for r in out:
        raw = (texts[r.id] or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(r.back) == want and r.type == "audio/wav" and r.length == len(r.media) and not r.corrected and r.embedded == []


def test_pipeline_takes_effect(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"wo{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    text = lambda n=60: " ".join(rnd.choices(words, k=n)) + "."
    junk = lambda: " ".join(f"{w.upper()}!!" for w in rnd.choices(words, k=60))
    item = text(40)
    docs = {i: text() for i in range(200)} | {i: junk() for i in range(200, 260)}
    docs |= {300: docs[0], 301: docs[1] + " one more", 302: text(20) + " " + item + " " + text(20), 303: text() + " mail me@x.example.com"}
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        assert name == "mixing" or sorted(df.columns) == sorted(columns)
    assert set(kept["quality_classifier"]) == set(docs) - set(range(200, 260))
    assert set(kept["quality_classifier"]) - set(kept["near_dedup"]) == {300, 301}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {302}
    assert set(kept["pii"]) == set(kept["decontamination"]) and kept["pii"][303].endswith("mail [EMAIL]") and kept["pii"][5] == docs[5]
    assert set(kept["mixing"]) <= set(kept["pii"]) and df.count() > 0.5 * len(kept["pii"])


def test_tiny_sources_reach_their_share(spark):
    docs = spark.createDataFrame([(i, "tiny" if i % 100 == 0 else "rare" if i == 1 else f"s{i % 3}", f"t{i}") for i in range(6000)], "doc_id long, source string, text string")
    rates = {r.source: r.rate for r in mixing.replication_rates(docs, max_rate=None).collect()}
    assert rates["tiny"] == 20 and rates["rare"] == 1200
    n = {r.source: r["count"] for r in mixing.mix_sources(docs).groupBy("source").count().collect()}
    assert all(abs(n[s] / 1200 - 1) < 0.15 for s in rates), n
    capped = mixing.mix_sources(docs, max_rate=4.0).filter("source = 'tiny'").count()
    assert 180 < capped < 300


def test_distribution_functions_of_any_mean(spark):
    means = [0.01, 1.0, 8.0, 30.0, 1200.0, 3e5]
    out = {r.rate: r for r in mixing.poisson_tables(spark.createDataFrame([(str(m), m) for m in means], "source string, rate double")).withColumn("rate", F.col("source").cast("double")).collect()}
    for m in means:
        total, cdf = 0.0, out[m].cdf
        for k, c in enumerate(cdf, out[m]["first"]):
            total += math.exp(k * math.log(m) - m - math.lgamma(k + 1))
            assert abs(c - total) < 1e-8
        assert abs(cdf[-1] - 1) < 1e-9 and cdf == sorted(cdf)


def test_media_inside_of_media_are_carved(spark):
    """What lies in a wave file's samples is found, the declared type is corrected."""
    wave = lambda data: b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
    samples = b"ab" + GIF + png()
    samples += b" " * (len(samples) % 2)
    twice = b"%PDF-1.4 startxref 0 %%EOF more startxref 9 %%EOF"
    flac = b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8\x00\x00"
    rows = [(1, wave(samples), "image/png"), (2, twice + b"\n" + twice, None), (3, flac + GIF, "audio/flac"), (4, None, None), (5, b"", "x"), (1, wave(samples), "image/png")]
    sniffed = media.sniff(spark.createDataFrame(rows, "id long, media binary, declared string"))
    out = {r.id: r for r in sniffed.collect()}
    assert out[1].type == "audio/wav" and out[1].corrected and out[1].length == len(rows[0][1])
    assert [(e.type, e.bytes) for e in media.carved(sniffed.filter("id = 1")).orderBy("offset").collect()] == 2 * [("image/gif", GIF)] + 2 * [("image/png", png())]
    assert (out[2].type, out[2].length) == ("application/pdf", len(twice)) and [(e.offset, e.length) for e in out[2].embedded] == [(len(twice) + 1, len(twice))]
    assert [e.type for e in out[3].embedded] == ["image/gif"] and (out[4].type, out[4].length) == (out[5].type, out[5].length) == ("application/octet-stream", 0)
    assert media.sniff(spark.createDataFrame([], "id long, media binary, declared string")).count() == 0


def test_located_media_against_every_offset():
    """The automaton and the validators against validators tried at every offset."""
    rnd = random.Random(7)
    parts = [png(), GIF, BMP, JPEG, b"GIF89a", b"BM", b"\x89PNG\r\n\x1a\n", b"%PDF-", b"\xff\xd8\xff"]
    signs, known = media.automaton(), media.VALIDATORS | {k: lambda v, at, f=f: f(v, at, {}) for k, f in media.WALKED.items()}
    for _ in range(60):
        value = b"".join(rnd.choice(parts) if rnd.random() < 0.6 else bytes(rnd.choices(b"abBM%\xff", k=rnd.randrange(9))) for _ in range(6))
        want = [(at, length, kind) for at in range(len(value)) for magic, (kind, before) in sorted(media.SIGNATURES.items()) if kind in known and value.startswith(magic, at + before) and (length := known[kind](value, at))]
        assert [x for x in media.located(value, signs) if x[2] in known] == want


def test_hostile_media_take_linear_time():
    began = time.time()
    for value in (b"\xff\xd8\xff" * 350_000, b"\xff\xd8\xff\xda\x00\x02" * 170_000, b"GIF89a" + bytes(7) + b"\x21\xf9" * 500_000, (b"GIF89a" + bytes(7) + b"\x21\x01\x05") * 60_000):
        assert media.located(value, media.automaton()) == []
    stream = b"fLaC\x00\x00\x00\x22" + bytes(34) + b"\x80\x00\x00\x01a" + b"\xff\xf8\x00\x00"
    found = media.located(stream * 20_000, media.automaton())
    assert len(found) == 20_000 and sum(n for _, n, _ in found) == 20_000 * len(stream)  # a stream ends where the next begins
    assert time.time() - began < 40


def test_pixels_round_trip(spark):
    texts = ["", None, "é" * 96, "x" * 193, "BM GIF89a", "long " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", media.payload_of(F.col("text")).alias("p")).withColumn("media", media.as_bmp(F.col("p"))).withColumn("declared", F.lit(None).cast("string"))
    for r in media.sniff(df).join(df.select("id", "p"), "id").withColumn("back", media.bmp_pixels(F.col("media"))).collect():
        assert (r.type, r.length, r.corrected) == ("image/bmp", len(r.media), True) and r.back == r.p


def test_wave_digests_against_plain_computation(spark):
    texts = ["", None, "a", "é" * 95, "x" * 192, "long " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", media.payload_of(F.col("text")).alias("p")).withColumn("media", media.as_wav(F.col("p")))
    for r in media.level_features(df, ["id", "media"], "p").collect():
        raw = (texts[r.id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert r.media == b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        x = [b - 128 for b in payload]
        signs = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert r.levels == f"{sum(x) / len(x):.6f}:{(sum(v * v for v in x) / len(x)) ** 0.5:.6f}:{signs}"


def test_sources_reach_their_weights(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "CASE WHEN id % 100 < 1 THEN 'rare' WHEN id % 100 < 40 THEN 'some' ELSE 'rest' END source", "id text")
    mixed = mixing.mix_sources(docs, {"rare": 2.0, "some": 1.0, "absent": 9.0}, other=1.0)
    shares = {r.source: r["count"] / mixed.count() for r in mixed.groupBy("source").count().collect()}
    assert shares == {"rare": pytest.approx(0.5, abs=0.03), "some": pytest.approx(0.25, abs=0.02), "rest": pytest.approx(0.25, abs=0.02)}


def test_reputation_blocks_hosts_without_a_rule(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'fine'}.org/{i}") for i in range(80)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(60)], "id long, good int")
    got = {(r.host, r.verdict) for r in url_reputation.judge_urls(pages, outcomes, RULES).collect()}
    assert got == {("spam.org", "block"), ("fine.org", "allow")}


def test_pairs_need_whole_numbers(spark):
    named = spark.createDataFrame([(c, 0, "assistant", f"answer of {c}") for c in ("a", "b", "c")], "conv_id string, turn int, role string, text string")
    got = {r.id: (r.chosen[0].text, [t.text for t in r.rejected]) for r in preference.answer_pairs(named).collect()}
    assert got == {"a": ("answer of a", ["answer of b"]), "b": ("answer of b", ["answer of a"]), "c": ("answer of c", [])}
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string, chosen string, id long")
    assert preference.format_preferences(preference.answer_pairs(empty)).count() == 0
