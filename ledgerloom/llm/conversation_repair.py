"""Repair of conversations: a forward Viterbi search over the role grammar ``(s?(ua)+)?``, conversation by conversation.

One shuffle deals the rows out by conversation; the sort within each task spills, and the search reads the sorted rows
as a stream. It carries the cheapest (cost, audit) for each of four states of the grammar and settles rows as soon as
the audits of all states agree on them, so that a conversation of any length needs memory for its unsettled rows, its
audit and the hash alone. (The hash over a whole conversation must be taken in order, by one task.)
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\x0b\f\r"
#: By state (nothing yet, after system, after user, after assistant): the initials that may follow, with the next state.
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SETTLE_EVERY = 32

VERDICT = T.StructType([T.StructField(k, T.LongType()) for k in "gaps blank duplicate truncated illegal cost".split()])
VERDICT = VERDICT.add("audit", "string").add("repaired_sha256", "string")


# ---------------------------------------------------------------- rows
def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(``conv_id:turn``) % 20 says, with ``live`` (false: dropped).

    Nulls of role and text, and within the hashed key of conv_id and turn, count as one space. Dropped rows stay, so
    that their conversation is known, without text. Repeated rows are damaged alike.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text, role = as_text("text"), as_text("role")
    text = F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    each = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        (kind != 0).alias("live"),
        F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return each.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out by conversation and sorted by turn (nulls first), role and text, with each one's first
    ``fault``: blank, duplicate (role and text of an earlier row) or truncated, else empty."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    alike = Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    solid = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(solid == "", "blank")
        .when(F.row_number().over(alike) > 1, "duplicate")
        .when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    dealt = rows.repartition("conv_id").withColumn("fault", fault)
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


# ---------------------------------------------------------------- the search
Layer = list[tuple[int, str] | None]


def _offer(layer: Layer, state: int, path: tuple[int, str]) -> None:
    if layer[state] is None or path < layer[state]:
        layer[state] = path


def close_layer(layer: Layer) -> Layer:
    """Inserted turns after a layer. Two rounds reach all: no cheapest path inserts three in a row."""
    for _ in range(2):
        for state, path in enumerate(list(layer)):
            for initial, to in NEXT[state].items():
                if path and initial in ROLE:
                    _offer(layer, to, (path[0] + INSERT, path[1] + "I"))
    done = layer[ASSISTANT]
    if done and layer[SYSTEM] and layer[SYSTEM][0] > done[0]:
        layer[SYSTEM] = None  # whatever follows it may follow a finished pair as well
    if done and layer[START] and layer[START][0] > done[0] + DELETE:
        layer[START] = None  # likewise, once a system turn is deleted
    return layer


def next_layer(layer: Layer, initial: str, fault: str) -> Layer:
    """The cheapest (cost, audit) of each state after one more row."""
    out: Layer = [None] * 4
    more = TRUNCATED if fault == "truncated" else 0
    for state, path in enumerate(layer):
        if not path:
            continue
        cost, audit = path
        _offer(out, state, (cost + DELETE, audit + "D"))
        if fault in ("blank", "duplicate"):
            continue
        for want, to in NEXT[state].items():
            if want == initial:
                _offer(out, to, (cost + more, audit + "K"))
            elif want in ROLE:
                _offer(out, to, (cost + REROLE + more, audit + "R"))
    return close_layer(out)


class Conversation:
    """The search over one conversation's rows; ``turns`` gets (edit, role, text) of each settled edit."""

    def __init__(self) -> None:
        self.layer = close_layer([(0, ""), None, None, None])
        self.open: list[tuple[str, str]] = []  # rows that are not settled
        self.at, self.audit, self.hash = START, [], hashlib.sha256()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.before = None
        self.rows = self.distinct = 0
        self.turns: list[tuple[str, str, str]] = []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.rows and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.before, self.rows = initial, self.rows + 1
        self.open.append((role, text))
        self.layer = next_layer(self.layer, initial, fault)
        if self.rows % SETTLE_EVERY == 0:
            agreed = len(os.path.commonprefix([p[1] for p in self.layer if p]))
            self.settle(next(p[1] for p in self.layer if p)[:agreed])
            self.layer = [p and (p[0], p[1][agreed:]) for p in self.layer]

    def settle(self, edits: str) -> None:
        """The grammar alone says which role a rerole or an insert gives: a system turn can only be kept, and first."""
        taken = 0
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.open[taken]
            taken += edit != "I"
            if edit != "D":
                if self.at == START and edit == "K" and role[:1] == "s":
                    step = "s"
                else:
                    step = "a" if self.at == USER else "u"
                role = role if edit == "K" else ROLE[step]
                self.hash.update(("" if self.at == START else "\n").encode() + f"{role}:{text}".encode())
                self.at = NEXT[self.at][step]
            self.turns.append((edit, role, text))
        self.audit.append(edits)
        del self.open[:taken]

    def verdict(self) -> dict:
        cost, edits = min(p for p in (self.layer[START], self.layer[ASSISTANT]) if p)
        self.settle(edits)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        gaps = min(gaps, 2**63 - 1)
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _repaired(batches: Iterator[pa.RecordBatch], out: pa.Schema, turns: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted; a conversation's settled turns as they come, and its verdict as its last row."""
    talk, key, seq, ready = None, None, 0, []

    def settled(last: bool) -> None:
        nonlocal seq
        verdict = talk.verdict() if last else None
        for edit, role, text in talk.turns if turns else ():
            ready.append({"conv_id": key, "seq": seq, "edit": edit, "role": role, "text": text, "verdict": None})
            seq += 1
        talk.turns = []
        if last:
            ready.append({"conv_id": key, "seq": None, "edit": None, "role": None, "text": None, "verdict": verdict})

    for batch in batches:
        for conv, turn, role, text, fault, live in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "live")), strict=True):
            if talk is None or conv != key:
                if talk:
                    settled(True)
                talk, key, seq = Conversation(), conv, 0
            if live:
                talk.add(turn, role, text, fault)
                if len(talk.turns) >= SETTLE_EVERY:
                    settled(False)
        yield pa.RecordBatch.from_pylist(ready, out)
        ready = []
    if talk:
        settled(True)
        yield pa.RecordBatch.from_pylist(ready, out)


def _run(rows: DataFrame, turns: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("seq", T.LongType())])
    schema = schema.add("edit", "string").add("role", "string").add("text", "string").add("verdict", VERDICT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _repaired(batches, to_arrow_schema(schema), turns)

    return with_faults(damaged(rows)).mapInArrow(run, schema)


def repair_verdicts(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text): gaps, faults, cost, audit and hash of the repair.

    A null conv_id is a conversation of its own. Rows of one turn are taken in order of role and text. A conversation
    without rows after the damage has zeros, an empty audit and the hash of the empty string. NaN-like or unknown roles
    are initials as any other: they can be reroled or deleted. Other columns of ``rows`` are left aside; an empty table
    gives no rows.
    """
    return _run(rows, turns=False).select("conv_id", "verdict.*")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order: conv_id, seq, edit (K, R, D, I), role and text after it.

    Deleted rows (D) are listed with the role and text they had; without them the rest is the repaired conversation.
    """
    return _run(rows, turns=True).where("verdict is null").drop("verdict")
