"""Personal data: formatted identifiers, and terms that give them away.

*Identifiers* are e-mail addresses, IPv4 addresses, payment cards, phone
numbers and secrets (keys and tokens: long mixed runs of letters and digits).
*Terms* are found by information-theoretic sanitisation: the corpus tells how
many texts hold a word together with a protected identifier and how many hold it
at all.  A word discloses an identifier if seeing the word makes the identifier
likely, p(e|t) >= ``min_share``, and tells many bits about it,
log2(p(e|t) / p(e)) >= ``min_bits``.  As most identifiers occur once, all of a
kind are an entity too: a word that is hardly ever seen without one of them
discloses the kind.  Such words are spans of kind ``term``.  Sanitised texts
have identifiers generalised to their kind, and terms to the kind that they
disclose.
"""

from __future__ import annotations

import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, join_narrow, stash, texts_of

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE_KINDS = KINDS[:4]
#: Terms that may travel with the tasks; more of them meet the texts in a join.
BLOCK_TERMS = 200_000
#: Ends the name of the entity that stands for all identifiers of a kind.
ANY = ":*"
#: Words that a task counts before it hands the counts on.
MOST_WORDS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts a run of digits and takes each whole, so that failing runs cost their length only
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_LONG = re.compile(r"[A-Za-z0-9_+/=-]{24,}+")
#: Changes between letters and digits that a secret has at least, for each eight characters.
_MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")

Span = tuple[int, int, str]


def _emails(text: str) -> list[Span]:
    """From each ``@`` outwards, so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end(), "email"))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of identifiers, by start and then kind as listed."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(text: str, taken: list[Span]) -> list[Span]:
    """Long runs of letters and digits, well mixed, outside of the spans taken."""
    found = [(m.start(), m.end()) for m in _LONG.finditer(text) if 8 * len(_MIXED.findall(m[0])) >= len(m[0])]
    return [(a, b, "secret") for a, b in found if all(b <= s[0] or s[1] <= a for s in taken)] if found else []


def identifier_spans(text: str) -> list[Span]:
    found = base_spans(text)
    return sorted(found + secret_spans(text, found), key=lambda s: (s[0], KINDS.index(s[2])))


def entity_of(text: str, span: Span) -> str:
    """An identifier's canonical form."""
    value = text[span[0] : span[1]]
    return f"{span[2]}:{value if span[2] == 'secret' else value.lower() if span[2] in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def term_spans(text: str, terms, taken: list[Span]) -> list[Span]:
    """Occurrences of the terms outside of the spans taken."""
    out, k = [], 0
    taken = sorted(taken)
    for m in _WORD.finditer(text):
        if m[0].lower() in terms:
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if all(m.end() <= s[0] or s[1] <= m.start() for s in taken[k : k + len(KINDS)]):
                out.append((m.start(), m.end(), "term"))
    return out


def all_spans(text: str, terms) -> list[Span]:
    """Identifiers and terms, by start and then kind as listed."""
    found = identifier_spans(text)
    return sorted(found + term_spans(text, terms, found), key=lambda s: (s[0], KINDS.index(s[2]))) if terms else found


def generalised(text: str, spans: list[Span], kinds: dict[str, str]) -> str:
    """Identifiers as ``[EMAIL]``, terms as ``[EMAIL TERM]`` by ``kinds``, the kind that a term discloses."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            name = f"{kinds.get(text[start:end].lower(), '')} term".strip() if kind == "term" else kind
            out += [text[at:start], f"[{name.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def words_of(text: str, spans: list[Span]) -> set[str]:
    """The lower-cased words outside of the spans."""
    out, at = set(), 0
    for start, end, _ in [*spans, (len(text), len(text), "")]:
        if start > at:
            out.update(_WORD.findall(text, at, start))
        at = max(at, end)
    return {w.lower() for w in out}


def _gathered(batches):
    """Of weighted texts: entities and words of those that hold identifiers, and how many texts hold a word."""
    kinds = [("weight", pa.float64()), ("entities", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("term", pa.string()), ("df", pa.float64())]

    def rows(**given):
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given.get(name, [None] * n), kind) for name, kind in kinds], [name for name, _ in kinds])

    total: dict[str, float] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            held: dict[str, list] = {"weight": [], "entities": [], "words": []}
            for text, weight in zip(texts_of(batch.column(0), start), batch.column(1).slice(start, SLICE).to_pylist(), strict=True):
                spans = identifier_spans(text)
                words = words_of(text, spans)
                for w in words:
                    total[w] = total.get(w, 0.0) + weight
                if spans:
                    held["weight"].append(weight)
                    held["entities"].append(sorted({entity_of(text, s) for s in spans} | {f"{s[2]}{ANY}" for s in spans}))
                    held["words"].append(sorted(words))
            yield rows(**held)
            if len(total) > MOST_WORDS:
                yield rows(term=list(total), df=list(total.values()))
                total.clear()
    yield rows(term=list(total), df=list(total.values()))


def _words_by_key(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            keys, terms = [], []
            for key, text in zip(batch.column(0).slice(start, SLICE).to_pylist(), texts_of(batch.column(1), start), strict=True):
                words = sorted(words_of(text, identifier_spans(text)))
                keys += [key] * len(words)
                terms += words
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(terms, pa.string())], ["__key", "term"])


def _with_terms(docs: DataFrame, text_col: str, terms: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``__terms``, and the terms to look for in every text with
    the kind that each discloses (of several the first by name).

    Up to BLOCK_TERMS terms, counted before, travel with the tasks; of more of
    them each row gets those that its text holds, by a join.
    """
    kind = F.substring_index("entity", ":", 1) if "entity" in terms.columns else F.lit("")
    terms = stash(terms.groupBy("term").agg(F.min(kind).alias("kind")))
    if terms.count() <= BLOCK_TERMS:
        return docs.withColumn("__terms", F.lit(None).cast("map<string,string>")), {r["term"]: r["kind"] for r in terms.collect()}
    keyed = stash(docs.withColumn("__key", F.expr("uuid()")))
    words = keyed.select("__key", F.col(text_col).cast("string")).mapInArrow(_words_by_key, "__key string, term string")
    own = words.join(terms, "term").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("__terms"))
    return keyed.join(own, "__key", "left").drop("__key"), {}


def disclosing_terms(docs: DataFrame, text_col: str = "text", min_texts: int = 2, min_share: float = 0.5, min_bits: float = 3.0, kind_share: float = 0.5, z: float = 3.3) -> DataFrame:
    """``term, entity, share, bits``: words that disclose an identifier, or a
    kind of them (entities like ``email:*``).

    All counts are of distinct texts, so copies of a text are no evidence, and
    a word goes with an identifier if a text holds both, however far apart.
    A share is smoothed by one more text with the term but not the identifier;
    an identifier in ``min_texts`` texts can have terms.  Kinds have many texts, so
    chance is what counts there: a word discloses a kind if the lower Wilson bound of its
    share, ``z`` standard errors down, is at least ``kind_share``, and that bound tells
    ``min_bits``.  The bound grows with the texts that hold the word, no number of them is fixed.
    Texts are read whole; null and empty ones don't count.  No identifiers give no rows.
    """
    text = docs.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''").withColumn("h", F.xxhash64("text"))
    sizes = stash(text.groupBy("h").agg(F.count("*").alias("copies")))
    totals = sizes.count()
    # each copy has its part of one text, so that no text is shuffled to drop the others
    weighted = join_narrow(text, sizes.filter("copies > 1"), "h", "left").select("text", (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))
    seen = stash(weighted.mapInArrow(_gathered, "weight double, entities array<string>, words array<string>, term string, df double"))
    number = lambda c: F.round(F.sum(c)).cast("long")
    held = seen.filter("entities is not null").select("weight", F.explode("entities").alias("entity"), "words")
    # others can't reach the bits, whatever their terms
    pooled = F.endswith("entity", F.lit(ANY))
    # a word that always goes with a kind reaches the bound with z^2 s / (1 - s) texts, no other with fewer
    fewest = math.ceil(z * z * kind_share / (1 - kind_share))
    enough = F.when(pooled, fewest).otherwise(min_texts)
    often = held.groupBy("entity").agg(number("weight").alias("n_e")).filter((F.col("n_e") >= enough) & (F.col("n_e") * 2.0**min_bits <= totals))
    often = stash(often)
    near = join_narrow(held, often, "entity").select("entity", "n_e", "weight", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.first("n_e").alias("n_e"), number("weight").alias("n_et")).filter(F.col("n_et") >= enough)
    df = seen.filter("term is not null").groupBy("term").agg(number("df").alias("df"))
    share = F.when(pooled, wilson(F.col("n_et"), F.greatest("df", "n_et"), z)).otherwise(F.col("n_et") / (F.col("df") + 1))
    known = near.join(df, "term").withColumn("share", share).withColumn("bits", F.log2(F.col("share") * totals / F.col("n_e")))
    return stash(known.filter((F.col("share") >= F.when(pooled, kind_share).otherwise(min_share)) & (F.col("bits") >= min_bits)).select("term", "entity", "share", "bits"), sizes, seen, often)


def wilson(x: Column, n: Column, z: float) -> Column:
    """The lower bound of a share of which ``x`` of ``n`` cases are seen."""
    p = x / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, **options) -> DataFrame:
    """One row per input row: id, ``spans`` (array of start, end, kind by start
    and kind; code points, end exclusive), ``text`` with identifiers
    generalised to their kind and terms to the kind that they disclose.

    ``terms(term, entity)`` are those of :func:`disclosing_terms` unless given;
    without entities they disclose no kind.
    Null and empty texts have no spans and become empty; very long ones are
    read whole, in time linear in their length.  Where spans overlap, the text
    gets the kind of the first.  Repeated rows are treated alike, other columns
    are ignored, no rows give no rows.
    """
    terms = terms if terms is not None else disclosing_terms(docs, text_col, **options)
    marked, known = _with_terms(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", terms)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<start:int,end:int,kind:string>>, text string"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                spans, clean = [], []
                for text, own in zip(texts_of(batch.column(1), start), batch.column(2).slice(start, SLICE).to_pylist(), strict=True):
                    kinds = known or dict(own or ())
                    found = all_spans(text, kinds)
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                    clean.append(generalised(text, found, kinds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, SLICE), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))), pa.array(clean, pa.string())], ["id", "spans", "text"])

    return marked.select("id", "text", "__terms").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sanitise(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with the text sanitised and, if there is such a column, its length set anew.

    Every row and column stays; a null text stays null, an empty one empty; very
    long texts are read and rewritten whole, in time linear in their length.
    Repeated rows are treated alike, no rows give no rows.  Columns of ``docs``
    may have any names but ``__terms`` and ``__key``.
    """
    marked, known = _with_terms(docs, text_col, disclosing_terms(docs, text_col, **options))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, terms: pd.Series) -> pd.Series:
        def one(text, own):
            kinds = known or dict(own or ())
            return None if text is None else generalised(text, all_spans(text, kinds), kinds)

        return pd.Series([one(text, own) for text, own in zip(texts, terms, strict=True)], dtype=object)

    done = marked.withColumn(text_col, clean(F.col(text_col).cast("string"), F.col("__terms"))).drop("__terms")
    return done.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else done
