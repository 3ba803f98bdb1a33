"""The operators bound to the tables of a data folder, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, media, mixing, near_dedup, pii, preference, quality, repair, runs, toxicity, url_reputation
from .common import crc_bucket, table

#: The vocabulary of op12: a file that every machine has.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict.  A page is labelled if its path ends in the number
    of a document that has a quality label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    doc_id = F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]{1,18})(?:[.]html|/)?(?:[?#]|$)', 1) as bigint)")
    labels = table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    outcomes = pages.select(F.col("page_id").alias("id"), doc_id.alias("doc_id")).join(labels, "doc_id").select("id", "good")
    return url_reputation.judge_urls(pages, outcomes, RULES)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 3) != 1)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, train))
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _joined_spans(spans: str, kinds: tuple[str, ...] | None = None):
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined_spans("spans", pii.BASE_KINDS), 256).alias("base_sha256"), _joined_spans("spans").alias("spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    every = docs.select("doc_id").join(found, "doc_id", "left")
    return every.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.col("n_items").isNotNull().alias("contaminated"))


#: Weights of the sources in the mix; a source without one has 1.
TARGETS = {f"src{k}": 1.0 + k % 4 for k in range(20)}


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to its share of the rows by TARGETS."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), TARGETS, other=1.0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 5) != 0)
    scored = quality.score_quality(docs, quality.fit(docs, train))
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.answer_pairs(table(spark, sf_dir, "conversations"))
    return preference.format_preferences(pairs).withColumnRenamed("id", "conv_id")


#: What op9 declares of values, and the bytes before the files that are stored inside of others.
DECLARED, WRAP = ("audio/wav", "image/bmp", "application/octet-stream", None), b"wrapped media:\x00\x01"


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as wave files or grey images, half of them behind other bytes, declared as one of four types, all by a hash of the text.

    Sniffing tells the type and where the file lies; that part is carved out and read back.
    """
    docs = table(spark, sf_dir, "documents")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    h = F.crc32(raw)
    payload = media.payload_of(F.col("text"))
    form = F.when(h % 2 == 0, media.as_wav(payload)).otherwise(media.as_bmp(payload))
    declared = F.get(F.array(*map(F.lit, DECLARED)), (F.floor(h / 4) % 4).cast("int"))
    stored = docs.select(F.struct("doc_id", F.octet_length(raw).cast("long").alias("n_bytes")).alias("id"), F.when(F.floor(h / 2) % 2 == 0, form).otherwise(F.concat(F.lit(WRAP), form)).alias("media"), declared.alias("declared"))
    first = F.get("embedded", F.lit(0))
    whole = F.struct(F.lit(0).cast("long").alias("offset"), F.col("length"), F.col("type"))
    read = media.sniff(stored).withColumn("at", F.when(F.col("length") > 0, whole).otherwise(first)).withColumn("file", media.cut_out(F.col("media"), F.col("at.offset"), F.col("at.length")))
    read = read.withColumn("payload", F.when(F.col("at.type") == "audio/wav", media.wav_samples(F.col("file"))).when(F.col("at.type") == "image/bmp", media.bmp_pixels(F.col("file"))))
    sniffed = F.concat_ws(":", "type", F.col("length").cast("string"), F.col("corrected").cast("string"), F.size("embedded").cast("string"), F.col("at.type"), F.col("at.offset").cast("string"))
    digests = read.select(
        "id", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2(F.col("media"), 256).alias("media_sha256"), sniffed.alias("sniffed"),
    )
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    levels = media.level_features(digests, ["id", *names, "sniffed"], "payload")
    return levels.select("id.doc_id", "id.n_bytes", *names, F.concat_ws(":", "sniffed", "levels").alias("feature"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def _repeating(doc_id, text):
    """One in ten texts with a stretch of its words repeated to its end, by the id's hash; the others as they are."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.when(n > 0, F.pmod(g, n))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs.periodic_runs(docs.select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def _damaged(conversations: DataFrame) -> DataFrame:
    """Rows that are dropped, emptied, cut, repeated or re-roled by the hash of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.encode(F.concat_ws(":", text("conv_id"), text("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).filter("h <> 0")
    changed = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    done = repair.repair_conversations(_damaged(conversations)).withColumnRenamed("conv_id", "done_id")
    every = conversations.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("done_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_minhash_dedup, op3_toxicity, op4_pii, op5_decontaminate, op6_mix_sources, op7_quality, op8_chat_preferences, op9_media, op10_html_text, op11_runs, op12_bpe, op13_conversation_repair)}

_SUFFIXES = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)


def _strength(level: str) -> str:
    return f"""(
  SELECT round(CASE WHEN rho > 0 THEN greatest(1, 1 / rho - 1) END, 6)
  FROM (SELECT (s - p * (1 - p) * (m - 1)) / nullif(p * (1 - p) * (t - nn / t - (m - 1)), 0) AS rho
        FROM (SELECT sum(x) / sum(n) AS p, sum(x * x / n) - sum(x) / sum(n) * sum(x) AS s, sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS nn, count(*) AS m
              FROM {level} WHERE n > 0)))"""



def _crc32(text: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    bit = "lambda c, i: xor(c // 2, (c % 2) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda crc, b: list_reduce(range(8), {bit}, xor(crc, b))), 4294967295)"


#: For op13: states (0 empty, 1 after system, 2 after user, 3 after pairs), what turns up to two insertions make of them, and what a kept or re-roled turn does.
_INSERTED = "(0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (2, 2, 'II'), (3, 3, ''), (3, 2, 'I'), (3, 3, 'II')"
_NEXT = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"

ORACLE_SQL = {
    "op13_conversation_repair": rf"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e FROM rows_),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
faults AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY 1),
ins(s, t, edits) AS (VALUES {_INSERTED}),
nxt(s, token, t) AS (VALUES {_NEXT}),
moves AS (
  SELECT s, t, '' AS need, edits || 'D' AS edits, 2 * length(edits) + 3 AS cost FROM ins
  UNION ALL SELECT ins.s, nxt.t, token, edits || 'K', 2 * length(edits) FROM ins JOIN nxt ON nxt.s = ins.t
  UNION ALL SELECT ins.s, nxt.t, '*', edits || 'R', 2 * length(edits) + 2 FROM ins JOIN nxt ON nxt.s = ins.t AND token <> 's'),
ways(conv_id, i, s, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM facts
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.t, min({{'cost': (best.cost + m.cost + CASE WHEN fault = 'truncated' AND m.need <> '' THEN 1 ELSE 0 END)::BIGINT, 'audit': best.audit || m.edits}})
  FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN moves m ON m.s = w.s AND (m.need = '' OR fault NOT IN ('blank', 'duplicate') AND (m.need = '*' OR m.need = left(role, 1)))
  GROUP BY ALL),
final AS (
  SELECT w.conv_id, min({{'cost': (best.cost + 2 * length(edits))::BIGINT, 'audit': best.audit || edits}}) AS best
  FROM ways w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN ins ON ins.s = w.s AND ins.t IN (0, 3) GROUP BY 1),
steps AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS k FROM final),
edits AS (SELECT conv_id, k, substr(audit, k::INT, 1) AS edit, length(replace(substr(audit, 1, k::INT), 'I', '')) AS i FROM steps),
kept AS (
  SELECT e.conv_id, k, edit, role, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY k) AS place
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND edit <> 'I' WHERE edit <> 'D'),
started AS (SELECT *, first_value(CASE WHEN edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS off FROM kept),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS t FROM started GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN final ON final.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op11_runs": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("doc_id::VARCHAR")} END AS h FROM docs),
dealt AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
bent AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM dealt),
old AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS w, a, p FROM bent),
word AS (SELECT o.r, o.i, s.w FROM old o JOIN old s ON s.r = o.r AND s.i = CASE WHEN o.i >= o.a THEN o.a + (o.i - o.a) % o.p ELSE o.i END),
grid AS (SELECT r, q, unnest(range(0, n - 3 * q, q)) AS i FROM (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM bent)),
coded AS (SELECT r * 4294967296 + i AS k, w FROM word),
cand AS (
  SELECT DISTINCT r, q FROM (SELECT g.r, g.q, x.w AS x, y.w AS y, z.w AS z, v.w AS v FROM (SELECT *, r * 4294967296 + i AS k FROM grid) g JOIN coded x ON x.k = g.k JOIN coded y ON y.k = g.k + g.q JOIN coded z ON z.k = g.k + 2 * g.q JOIN coded v ON v.k = g.k + 3 * g.q)
  WHERE CASE WHEN x = y AND y = z AND z = v THEN 1 ELSE 0 END = 1),
pairs AS (SELECT c.r, c.q, x.i, x.w AS x, y.w AS y FROM cand c JOIN word x ON x.r = c.r JOIN coded y ON y.k = x.r * 4294967296 + x.i + c.q),
same AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs WHERE CASE WHEN x = y THEN 1 ELSE 0 END = 1),
wide AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM same GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM wide a WHERE NOT EXISTS (SELECT 1 FROM wide b WHERE b.r = a.r AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM word x WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = x.r AND x.i >= u.s + u.q AND x.i < u.s + u.l) GROUP BY 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t, first({{'s': s, 'l': l, 'q': q}} ORDER BY l DESC, s, q) AS best FROM runs GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS "start", best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)""",
    "op1_url_filter": rf"""
WITH rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
named AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         try_cast(regexp_extract(url, '^[^?#]*/([0-9]{{1,18}})(?:[.]html|/)?(?:[?#]|$)', 1) AS BIGINT) AS doc_id
  FROM pages),
good AS (SELECT doc_id, max(quality) AS g FROM labels WHERE quality IS NOT NULL GROUP BY 1),
bare AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b, g FROM named LEFT JOIN good USING (doc_id)),
cut AS (SELECT *, array_to_string(string_split(b, '.')[-2:], '.') AS l2, array_to_string(string_split(b, '.')[-3:], '.') AS l3, string_split(b, '.')[-1] AS l1 FROM bare),
hosts AS (
  SELECT host, CASE WHEN regexp_matches(b, '^[0-9.]+$') THEN b WHEN l2 IN ({_SUFFIXES}) THEN l3 ELSE l2 END AS domain,
         CASE WHEN regexp_matches(b, '^[0-9.]+$') THEN 'address' WHEN l2 IN ({_SUFFIXES}) THEN l2 ELSE l1 END AS suffix,
         count(g)::DOUBLE AS n, coalesce(sum(g), 0)::DOUBLE AS x
  FROM cut GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY ALL),
k AS (SELECT {_strength("hosts")} AS kh, {_strength("domains")} AS kd, {_strength("suffixes")} AS ks, (SELECT (sum(x) + 1) / (sum(n) + 2) FROM suffixes) AS base),
by_suffix AS (SELECT suffix, coalesce((x + ks * base) / nullif(n + ks, 0), base) AS m FROM suffixes, k),
by_domain AS (SELECT domain, d.suffix, coalesce((d.x + kd * m) / nullif(d.n + kd, 0), m) AS m FROM domains d JOIN by_suffix USING (suffix), k),
mean AS (SELECT host, n, coalesce((x + kh * m) / nullif(n + kh, 0), m) AS mean, kh FROM hosts JOIN by_domain USING (domain, suffix), k),
judged AS (SELECT host, mean - 1.645 * coalesce(sqrt(mean * (1 - mean) / (n + kh + 1)), 0) AS bound FROM mean),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(rules.verdict, length(h || p)) AS verdict
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, round(bound, 6) AS bound
FROM named JOIN judged USING (host) LEFT JOIN fit USING (page_id)""",
    "op2_minhash_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN twoway l ON r.b = l.a),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of USING (doc_id)""",
    "op5_decontaminate": rf"""
WITH tok AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{{-~]+', '', 'g'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{{-~]+', '', 'g'), '[\x09-\x0D\x20]+'), lambda w: w <> '') FROM benchmark),
masks(m, mask) AS (VALUES {", ".join(f"({i}, '{m}')" for i, m in enumerate(decontaminate.MASKS))}),
seeds AS (
  SELECT side, id, m, i, length(mask) AS span, array_to_string(list_transform(list_filter(range(0, length(mask)), lambda j: substr(mask, (j + 1)::INT, 1) = '1'), lambda j: t[i + j]), ' ') AS s
  FROM (SELECT *, unnest(range(1, len(t) - 6)) AS i FROM tok), masks WHERE i + length(mask) - 1 <= len(t)),
parts AS (
  SELECT id, unnest([{{'i': 1, 'n': first}}, {{'i': first + 1, 'n': len(t) - first}}]) AS h, t
  FROM (SELECT id, t, CASE WHEN len(t) <= 4 THEN len(t) ELSE (len(t) + 1) // 2 END AS first FROM tok WHERE side = 'b' AND len(t) BETWEEN 1 AND {decontaminate.SHORT_ITEM})),
runs AS (SELECT id, h.i AS i, h.n AS n, array_to_string(t[h.i:h.i + h.n - 1], ' ') AS s FROM parts WHERE h.n > 0),
run_hits AS (
  SELECT d.id AS doc_id, r.id AS item_id, d.i AS di, r.i AS bi, r.n AS span
  FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM tok WHERE side = 'd') d JOIN runs r ON array_to_string(d.t[d.i:d.i + r.n - 1], ' ') = r.s
  WHERE EXISTS (SELECT 1 FROM runs)),
hits AS (
  SELECT d.id AS doc_id, b.id AS item_id, d.i AS di, b.i AS bi, b.span FROM seeds d JOIN seeds b ON d.side = 'd' AND b.side = 'b' AND d.m = b.m AND d.s = b.s
  UNION SELECT * FROM run_hits),
near AS (
  SELECT h.doc_id, h.item_id, len(list_filter(range(greatest(1, bi - {decontaminate.REACH}), least(len(b.t), bi + span + {decontaminate.REACH} - 1) + 1), lambda j: di - bi + j >= 1 AND d.t[di - bi + j] = b.t[j])) AS matched,
         least(len(b.t), bi + span + {decontaminate.REACH} - 1) - greatest(1, bi - {decontaminate.REACH}) + 1 AS size
  FROM hits h JOIN tok d ON d.side = 'd' AND d.id = h.doc_id JOIN tok b ON b.side = 'b' AND b.id = h.item_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, max(matched) AS matched FROM near WHERE matched >= 0.8 * size GROUP BY 1)
SELECT doc_id, coalesce(n_items, 0)::BIGINT AS n_items, first_item, coalesce(matched, 0)::BIGINT AS matched, n_items IS NOT NULL AS contaminated FROM documents LEFT JOIN found USING (doc_id)""",
    "op6_mix_sources": rf"""
WITH weights(s, w) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in TARGETS.items())}),
sizes AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT s, coalesce(w, 1.0)::DOUBLE * ((sum(n) OVER ())::DOUBLE / (sum(coalesce(w, 1.0)) OVER ())::DOUBLE) / n AS rate FROM sizes LEFT JOIN weights USING (s)),
cdf AS (SELECT s, list(c ORDER BY k) AS cdf FROM (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM rates, range(0, 200) r(k)) GROUP BY 1),
counted AS (
  SELECT d.*, len(list_filter(cdf, lambda c: ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 >= c)) AS n
  FROM documents d JOIN cdf ON s = coalesce(source, '')),
copies AS (SELECT * EXCLUDE (n), unnest(range(1, n + 1))::INT AS copy FROM counted WHERE n > 0)
SELECT *, substr(md5('mix/order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 16) AS shuffle_key FROM copies""",
    "op8_chat_preferences": r"""
WITH convs AS (SELECT conv_id AS id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
ends AS (SELECT id, t, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS last FROM convs),
pairs AS (
  SELECT a.id, CASE WHEN a.last IS NULL THEN a.t ELSE a.t[1:a.last] END AS c,
         CASE WHEN a.last IS NULL THEN a.t WHEN b.last IS NULL THEN a.t[1:a.last - 1] ELSE list_concat(a.t[1:a.last - 1], [b.t[b.last]]) END AS r
  FROM ends a LEFT JOIN ends b ON b.id = xor(a.id, 1)),
cut AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: i > len(c) OR i > len(r) OR c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS n FROM pairs),
parts AS (SELECT id, n::INT AS n_prompt_turns, c[1:n] AS p, c[n + 1:len(c)] AS a, r[n + 1:len(r)] AS b FROM cut),
text AS (
  SELECT id, n_prompt_turns, list_transform(p, lambda t: '<|' || coalesce(t.role, '') || E'|>\n' || coalesce(t.text, '') || E'<|end|>\n') AS p,
         list_transform(a, lambda t: '<|' || coalesce(t.role, '') || E'|>\n' || coalesce(t.text, '') || E'<|end|>\n') AS ta,
         list_transform(b, lambda t: '<|' || coalesce(t.role, '') || E'|>\n' || coalesce(t.text, '') || E'<|end|>\n') AS tb, a, b FROM parts),
done AS (
  SELECT id AS conv_id, n_prompt_turns, array_to_string(p, '') AS prompt, array_to_string(ta, '') AS chosen, array_to_string(tb, '') AS rejected,
         coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant'), lambda i: (length(array_to_string(ta[1:i - 1], '')) + length(a[i].role) + 5) || ':' || (length(array_to_string(ta[1:i], '')) - 1)), ','), '') AS chosen_mask,
         coalesce(array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'), lambda i: (length(array_to_string(tb[1:i - 1], '')) + length(b[i].role) + 5) || ':' || (length(array_to_string(tb[1:i], '')) - 1)), ','), '') AS rejected_mask
  FROM text)
SELECT *, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM done""",
}
