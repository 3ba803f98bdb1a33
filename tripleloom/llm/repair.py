"""Conversation structure repair: a generalised LR parser with edits.

A conversation should be empty, or pairs of a user and an assistant turn after at most
one system turn.  The parser reads the turns of a conversation with the table
of that grammar below and keeps a graph-structured stack: its tops are states of the
table, each with a link to the node below it.  At each turn it inserts,
deletes, keeps or re-roles; tops of equal state merge into the one with the least
(cost, audit), where the audit is the initials of all edits so far.

1. Repeated rows are counted, and all rows are sorted by conversation and turn
   into ranges, so a conversation of any length is spread over tasks.
2. A task reads its range in blocks.  Conversations that lie within a block are done there.  For
   other blocks, the cheapest edits from every state to every state are found.
3. The blocks of a conversation are chained by these, and their texts put together.

Two audits that consume the same turns and end in a consumed one are never
prefixes of each other, so they compare by the ranks of their beginnings.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_narrow, stash

#: The LR table.  Rules: list = pair | system pair | list pair; pair = user assistant.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 4}, 3: {"u": 2}}
REDUCE = {4: (2, "pair"), 5: (1, "list"), 6: (2, "list"), 7: (2, "list")}
GOTO = {(0, "pair"): 5, (1, "pair"): 6, (3, "pair"): 7, (0, "list"): 3}
ACCEPT = (0, 3)
#: What is below a top at the begin of a block doesn't matter: after a pair all stacks are alike.
BELOW = {0: (), 1: (0,), 2: (0,), 3: (0,)}
ROLES = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 20


class _Node:
    """A stack top: its state and the node below."""

    __slots__ = ("state", "below")

    def __init__(self, state: int, below: _Node | None):
        self.state, self.below = state, below


def _bottom(state: int) -> _Node:
    node = None
    for s in (*BELOW[state], state):
        node = _Node(s, node)
    return node


def _shift(node: _Node, token: str) -> _Node | None:
    """The top after a token and all reductions; None if the table has no action."""
    state = SHIFT[node.state].get(token)
    if state is None:
        return None
    node = _Node(state, node)
    while node.state in REDUCE:
        size, name = REDUCE[node.state]
        for _ in range(size):
            node = node.below
        node = _Node(GOTO[node.state, name], node)
    return node


def _insertions(node: _Node):
    """The top itself, and those after one or two inserted turns."""
    yield node, ""
    for k in ("I", "II"):
        node = next(x for x in (_shift(node, "u"), _shift(node, "a")) if x)
        yield node, k


def _moves(node: _Node, turn: str):
    """(top, edits, cost) after a turn: ``s``, ``u``, ``a`` or ``x`` by its role, upper case if truncated, ``D`` to be deleted."""
    for top, inserted in _insertions(node):
        cost = COST["I"] * len(inserted)
        yield top, inserted + "D", cost + COST["D"]
        if turn != "D":
            cost += turn.isupper()
            kept = _shift(top, turn.lower())
            if kept:
                yield kept, inserted + "K", cost
            for token in ROLES:
                other = _shift(top, token)
                if other:
                    yield other, inserted + "R", cost + COST["R"]


def _parse(turns: str, entry: int) -> dict[int, tuple[int, int, _Node, tuple]]:
    """By state of the top: cost, rank of its audit among the tops, top, trace of edits."""
    tops = {entry: (0, 0, _bottom(entry), None)}
    for turn in turns:
        best: dict[int, tuple] = {}
        for cost, rank, node, trace in tops.values():
            for top, edits, more in _moves(node, turn):
                key = (cost + more, rank, edits)
                if top.state not in best or key < best[top.state][0]:
                    best[top.state] = (key, top, (trace, edits))
        order = sorted(best, key=lambda s: best[s][0][1:])
        tops = {s: (best[s][0][0], order.index(s), *best[s][1:]) for s in best}
    return tops


def _text(trace: tuple | None) -> str:
    parts = []
    while trace:
        trace, edits = trace
        parts.append(edits)
    return "".join(reversed(parts))


def paths(turns: str, entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) to each state, without insertions at the end."""
    return {s: (cost, _text(trace)) for s, (cost, _, _, trace) in _parse(turns, entry).items()}


def finish(ways: dict[int, tuple[int, int, str]]) -> tuple[int, str, int]:
    """Of (cost, rank, audit) by state: the least (cost, audit) that ends in an accepting state, and its state before that."""
    done = [(cost + 2 * len(i), rank, i, audit, s) for s, (cost, rank, audit) in ways.items() for top, i in _insertions(_bottom(s)) if top.state in ACCEPT]
    cost, _, inserted, audit, state = min(done, key=lambda d: d[:3])
    return cost, audit + inserted, state


def apply(rows: list[tuple[str, str]], audit: str, entry: int = 0) -> list[tuple[str, str]]:
    """The turns after edits."""
    node, out, at = _bottom(entry), [], 0
    for edit in audit:
        if edit != "I":
            role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            token = role[:1]
        else:
            token = next(t for t in ROLES if t in SHIFT[node.state])
            role, text = ROLES[token], text if edit == "R" else ""
        node = _shift(node, token)
        out.append((role, text))
    return out


def _turn(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "D"
    token = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return token.upper() if fault == "truncated" else token


FACTS = ("lowest", "highest", "distinct", "first", "last", "blank", "duplicate", "truncated", "illegal", "opens", "closes")


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _facts(rows: list[tuple]) -> dict:
    """Counts of a block of (turn, role, text, fault), and what its neighbours need to know."""
    turns = [r[0] for r in rows if r[0] is not None]
    faults = [r[3] for r in rows]
    return dict(zip(FACTS, (
        turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(not _legal(a[1], b[1]) for a, b in zip(rows, rows[1:])), rows[0][1][:1], rows[-1][1][:1],
    ), strict=True))


def _chained(blocks: list[dict]) -> dict:
    """The facts of neighbouring blocks together."""
    out = dict(blocks[0])
    for b in blocks[1:]:
        if b["first"] is not None:
            out["distinct"] += b["distinct"] - (out["last"] == b["first"])
            out["lowest"] = b["lowest"] if out["lowest"] is None else out["lowest"]
            out["highest"] = out["last"] = b["last"]
        out["illegal"] += b["illegal"] + (not _legal(out["closes"], b["opens"]))
        out["closes"] = b["closes"]
        for k in ("blank", "duplicate", "truncated"):
            out[k] += b[k]
    return out


def _result(facts: dict, cost: int, audit: str, repaired: str) -> dict:
    gaps = 0 if facts["lowest"] is None else facts["highest"] - facts["lowest"] + 1 - facts["distinct"]
    return {"gaps": gaps, **{k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired": repaired}


def _lines(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


#: A block that belongs to a longer conversation, and a repaired conversation.
_BLOCK = pa.struct([("seq", pa.int64()), *[(k, pa.string() if k in ("opens", "closes") else pa.int64()) for k in FACTS], ("turns", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_DONE = pa.struct([*[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired", pa.string())])
_SPARK = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.string()): "array<string>"}
_NAMES = lambda t: ", ".join(f"{t.field(i).name}: {_SPARK[t.field(i).type]}" for i in range(t.num_fields))


def _open(rows: list[tuple], seq: int) -> dict:
    return {"seq": seq, **_facts(rows), "turns": "".join(_turn(r[1], r[3]) for r in rows), "roles": [r[1] for r in rows], "texts": [r[2] for r in rows]}


def _whole(rows: list[tuple], known) -> dict:
    ways = {s: (cost, audit, audit) for s, (cost, audit) in known("".join(_turn(r[1], r[3]) for r in rows), 0).items()}
    cost, audit, _ = finish(ways)
    return _result(_facts(rows), cost, audit, _lines(apply([r[1:3] for r in rows], audit)))


def _blocks(batches):
    """Sorted rows (part, id, turn, role, text, fault, times) to repaired conversations, and to blocks of those that may go on elsewhere."""
    rows: list[tuple] = []
    ids: list = []
    blocks: list = []
    results: list = []
    seq = size = 0
    now = object()
    edge = False  # the conversation may have begun in another range, or has a block already
    kind = None
    known = lru_cache(1 << 14)(paths)  # many conversations have the same turns; made here, as tasks get functions whole

    def flush():
        nonlocal ids, blocks, results
        out = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(blocks, _BLOCK), pa.array(results, _DONE)], ["id", "block", "done"])
        ids, blocks, results = [], [], []
        return out

    def put(is_open: bool):
        nonlocal seq, rows, size
        if rows:
            ids.append(now)
            blocks.append(_open(rows, seq) if is_open else None)
            results.append(None if is_open else _whole(rows, known))
            seq, rows, size = seq + 1, [], 0

    for batch in batches:
        kind = batch.column(1).type
        if not seq and not rows:
            seq = batch.column(0)[0].as_py() << 40
            edge = True
            now = batch.column(1)[0].as_py()
        for _, id_, turn, role, text, fault, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if id_ != now:
                put(edge)
                now, edge = id_, False
            for k in range(times):
                if len(rows) >= BLOCK_ROWS or size > BLOCK_CHARS:
                    edge = True
                    put(True)
                rows.append((turn, role, text, fault if not k or fault == "blank" else "duplicate"))
                size += len(text)
            if len(ids) >= 256:
                yield flush()
    if kind is not None:
        put(True)
        yield flush()


def _chain(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a conversation, as one."""
    blocks = [b for b in sorted(frame["block"], key=lambda b: b["seq"])]
    ways: dict[int, tuple[int, int, tuple]] = {0: (0, 0, None)}
    for b in blocks:
        best: dict[int, tuple] = {}
        for entry, (cost, rank, trace) in ways.items():
            for state, (more, audit) in paths(b["turns"], entry).items():
                k = (cost + more, rank, audit)
                if state not in best or k < best[state][0]:
                    best[state] = (k, (trace, (entry, audit)))
        order = sorted(best, key=lambda s: best[s][0][1:])
        ways = {s: (best[s][0][0], order.index(s), best[s][1]) for s in best}
    cost, inserted, state = finish({s: (c, r, "") for s, (c, r, _) in ways.items()})
    steps, trace = [], ways[state][2]
    while trace:
        trace, step = trace
        steps.append(step)
    steps.reverse()
    texts, ends = [], []
    for i, (b, (entry, audit)) in enumerate(zip(blocks, steps, strict=True)):
        ends.append(audit + (inserted if i == len(blocks) - 1 else ""))
        lines = _lines(apply(list(zip(b["roles"], b["texts"], strict=True)), ends[-1], entry))
        if lines:
            texts.append(lines)
    done = _result(_chained([{k: None if pd.isna(b[k]) else b[k] for k in FACTS} for b in blocks]), cost, "".join(ends), "\n".join(texts))
    return pd.DataFrame([{"id": key[0], **done}])


def with_faults(rows: DataFrame) -> DataFrame:
    """``(id, turn, role, text)`` as distinct rows with ``times`` and the first fault of each: blank, duplicate, truncated or ''.

    A duplicate has a role and a text that an earlier turn has; what ``times`` counts beyond the first is one as well.
    """
    counted = stash(rows.groupBy("id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit("again"), "text", "role")}))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = counted.groupBy("id", "k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("id_"), F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("several"))
    on = F.col("id").eqNullSafe(F.col("id_")) & (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_"))
    marked = join_narrow(counted, stash(firsts), on, "left")
    end = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = F.when(end == "", "blank").when(F.coalesce("several", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn")), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return marked.select("id", "turn", "role", "text", fault.alias("fault"), "times")


def repair_conversations(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation that has rows: ``(id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)``.

    ``conversations(id_col, turn, role, text)``: a null role or text counts as
    one space, null turns come first, rows of one turn stand by role and text, and the null id is a conversation.
    Rows that repeat a row are duplicates (or blank).  ``repaired`` has a line
    ``role:text`` for each turn that is left, '' for none.  No rows give none; other
    columns, whatever their names, are left out.  A conversation of any number of rows is
    read in blocks by several tasks; its repaired text is one value, so the task that puts it
    together holds that value (2 GB at most) and its blocks.  Long texts are whole.
    """
    rows = conversations.select(F.col(id_col).alias("id"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    kind = rows.schema["id"].dataType.simpleString()
    ranged = with_faults(rows).repartitionByRange("id", "turn", "role", "text").sortWithinPartitions("id", "turn", "role", "text")
    placed = ranged.select(F.spark_partition_id().cast("long").alias("part"), "id", "turn", "role", "text", "fault", "times")
    found = stash(placed.mapInArrow(_blocks, f"id {kind}, block struct<{_NAMES(_BLOCK)}>, done struct<{_NAMES(_DONE)}>"))
    fields = _NAMES(_DONE).replace(": ", " ")
    chained = found.filter("done is null").select("id", "block").groupBy("id").applyInPandas(_chain, f"id {kind}, {fields}")
    return found.filter("done is not null").select("id", "done.*").union(chained).withColumnRenamed("id", id_col)
