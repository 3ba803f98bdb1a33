"""Chat formatting of preference pairs.

The longest common turn prefix of the chosen and the rejected conversation is
rendered once, as the prompt; what follows is rendered for each side, with the
character spans of its assistant texts as the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import numbered
from .common import stash

HEAD, AFTER_ROLE, TAIL = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def rendered(turns: Column) -> Column:
    """Turns as text, one after another; a null role or text is empty."""
    one = lambda t: F.concat(F.lit(HEAD), F.coalesce(t["role"], F.lit("")), F.lit(AFTER_ROLE), F.coalesce(t["text"], F.lit("")), F.lit(TAIL))
    return F.array_join(F.transform(turns, one), "")


def mask_spans(turns: Column, role: str = "assistant") -> Column:
    """``start:end`` of each text of ``role`` with its end mark in ``rendered(turns)``, comma-joined."""
    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(F.coalesce(t["role"], F.lit(""))) + len(HEAD) + len(AFTER_ROLE)
        end = start + F.length(F.coalesce(t["text"], F.lit(""))) + len(TAIL)
        span = F.concat(start.cast("string"), F.lit(":"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns are equal (role and text, null equal to null)."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def conversations_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, turns``: the turns of each conversation in order (ties by role, then text).

    A conversation is one record and is held as one row.  Rows without an id
    belong to none.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kept = turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return kept.select("id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS).alias("turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``id, chosen, rejected`` (arrays of role and text) to one row per pair:
    id, n_prompt_turns, prompt, chosen, rejected (rendered completions),
    chosen_mask, rejected_mask, usable.

    A null conversation counts as empty.  A pair is usable if its completions
    differ and both have an assistant text; other pairs are returned all the
    same.  Very long turns are rendered whole.  Repeated rows are formatted
    alike, other columns are ignored, no rows give no rows.
    """
    side = lambda c: F.coalesce(F.col(c), F.array().cast(TURNS)).cast(TURNS)
    both = pairs.select("id", side("chosen").alias("a"), side("rejected").alias("b")).withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    out = both.select("id", "n", F.slice("a", 1, F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return out.select(
        "id", F.col("n").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"),
        mask_spans(F.col("a")).alias("chosen_mask"), mask_spans(F.col("b")).alias("rejected_mask"),
    ).withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


def answer_pairs(turns: DataFrame, **columns) -> DataFrame:
    """Preference pairs out of plain conversations, for tables without any.

    Chosen is a conversation up to its last assistant turn.  Rejected is the
    same up to there, with the last assistant turn of its neighbour instead: an answer to
    something else.  The neighbour of a whole number has the last bit flipped; other ids are
    numbered in their order, and the number's last bit is flipped.  Without
    a neighbour's answer nothing follows; a conversation without an assistant
    turn is its own rejected side.  Turns after the last assistant turn answer
    nothing and are on neither side.  Very long conversations and texts are taken whole.
    """
    name = columns.get("id_col", "conv_id")
    role = lambda t: t["role"] == "assistant"
    convs = conversations_of(turns, **columns).withColumn("last", F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(role(t), F.lit(False)))), True) + 1)
    convs = convs.withColumn("last", F.when(F.exists("turns", role), F.col("last").cast("int")))
    other = F.element_at("turns", F.col("last")).alias("other")
    answering = convs.filter("last is not null")
    if isinstance(turns.schema[name].dataType, T.IntegralType):
        answers = answering.select(F.expr("id ^ 1").alias("id"), other)
    else:
        places = stash(numbered(convs.select("id").filter("id is not null"), ["id"]).select("id", (F.col("number") - 1).alias("place")))
        answers = answering.join(places, "id").select(F.expr("place ^ 1").alias("place"), other).join(places, "place").select("id", "other")
    cut = F.slice("turns", 1, F.col("last"))
    history = F.slice("turns", 1, F.col("last") - 1)
    rejected = F.when(F.col("last").isNull(), F.col("turns")).when(F.col("other").isNull(), history).otherwise(F.concat(history, F.array("other")))
    return convs.join(answers, "id", "left").select("id", F.coalesce(cut, F.col("turns")).alias("chosen"), rejected.alias("rejected"))
