"""Repair of conversations by weighted finite-state composition.

The rows of a conversation are a linear acceptor, the edits a transducer of one state, the order of
roles an acceptor of four. Their composition has a state for each (rows read, grammar state); its arcs
are made as they are asked for. Weights are (cost, label string) in lexicographic order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import materialize

#: Costs of edits, and of leaving a truncated row in.
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The acceptor of (s?(ua)+)?: arcs by role initial from each state, and final states.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
GRAMMAR = ({"s": AFTER_SYSTEM, "u": AFTER_USER}, {"u": AFTER_USER}, {"a": AFTER_ASSISTANT}, {"u": AFTER_USER})
FINAL = (START, AFTER_ASSISTANT)
MADE = {"u": "user", "a": "assistant"}
FAR = float("inf")
#: White space of the contract, and how much text of a conversation a task holds before it goes the long way.
SPACE, HELD_CHARS = "\x20\x09\x0a\x0b\x0c\x0d", 1 << 24


@lru_cache(4096)
def arcs(kind: tuple[str, str] | None, state: int) -> tuple[tuple[str, int, int], ...]:
    """Composed arcs (label, cost, next grammar state) from a grammar state before a row of that kind, (role initial, fault), in the order of labels.

    Labels: D deletes the row, I inserts a row before it, K keeps it, R gives it another role. After the last row (None) rows can only be inserted.
    """
    insert = tuple(("I", INSERT, GRAMMAR[state][c]) for c in MADE if c in GRAMMAR[state])
    if kind is None:
        return insert
    initial, fault = kind
    out = [("D", DELETE, state), *insert]
    if fault not in ("blank", "duplicate"):
        left = TRUNCATED if fault == "truncated" else 0
        if initial in GRAMMAR[state]:
            out.append(("K", left, GRAMMAR[state][initial]))
        out += [("R", left + RETYPE, GRAMMAR[state][c]) for c in MADE if c in GRAMMAR[state]]
    return tuple(out)


@lru_cache(65_536)
def distances(kind: tuple[str, str] | None, after: tuple[float, ...]) -> tuple[float, ...]:
    """Cheapest costs to the end from each grammar state before a row, given those after it (before the last: those of final states).

    Inserts stay before the row, in a chain of at most as many as there are states, so rounds of them are in topological order.
    """
    best = [min((cost + after[to] for label, cost, to in arcs(kind, q) if label != "I"), default=FAR) if kind else after[q] for q in range(4)]
    for _ in range(3):
        best = [min([best[q], *(cost + best[to] for label, cost, to in arcs(kind, q) if label == "I")]) for q in range(4)]
    return tuple(best)


def shortest_path(kinds: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, labels) of the least path by cost, then by labels.

    Costs to the end are taken backwards over the rows; the path then follows, from the start, the least
    label among arcs that stay on a cheapest path. An arc's label and source fix its target, so equal
    strings end in one state, and a string that may end is less than all that go on.
    """
    togo: list[tuple[float, ...]] = [distances(None, tuple(0 if q in FINAL else FAR for q in range(4)))]
    for kind in reversed(kinds):
        # costs relative to the least, so that few different vectors occur and steps are remembered
        least = min(togo[-1])
        found = distances(kind, tuple(x - least for x in togo[-1]))
        togo.append(tuple(x + least for x in found))
    togo.reverse()
    labels, row, state = [], 0, START
    while True:
        left = togo[row][state]
        if row == len(kinds) and state in FINAL:
            return int(togo[0][START]), "".join(labels)
        kind = kinds[row] if row < len(kinds) else None
        label, _, state, row = next((lab, c, to, row + (lab != "I")) for lab, c, to in arcs(kind, state) if c + togo[row + (lab != "I")][to] == left)
        labels.append(label)


class Speaker:
    """Follows the labels of a path over the rows and hashes what comes out, one role:text a line."""

    def __init__(self, labels: str):
        self.labels, self.at, self.state, self.digest, self.some = labels, 0, START, hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.some else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True
        self.state = GRAMMAR[self.state][role[:1]]

    def make(self) -> str:
        """The role that the grammar asks for next."""
        return next(MADE[c] for c in MADE if c in GRAMMAR[self.state])

    def row(self, role: str, text: str) -> None:
        """One row: inserts before it, then its own label."""
        self.inserts()
        label = self.labels[self.at]
        self.at += 1
        if label != "D":
            self.say(role if label == "K" else self.make(), text)

    def inserts(self) -> None:
        while self.at < len(self.labels) and self.labels[self.at] == "I":
            self.at += 1
            self.say(self.make(), "")

    def end(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


class Conversation:
    """What a task keeps of one conversation: a kind a row, digests of its distinct rows, counts, and its texts up to HELD_CHARS."""

    def __init__(self, held_chars: int):
        self.kinds: list[tuple[str, str]] = []
        self.seen: set[bytes] = set()
        self.texts: list[tuple[str, str]] | None = []
        self.room = held_chars
        self.low = self.high = self.last_turn = None
        self.turns = self.illegal = 0

    def add(self, turn: str | None, role: str, text: str, blank: bool, cut: bool) -> None:
        if turn is not None:
            number = int(turn)
            self.turns += number != self.last_turn
            self.low, self.high, self.last_turn = number if self.low is None else self.low, number, number
        initial = role[:1]
        self.illegal += bool(self.kinds) and self.kinds[-1][0] + initial not in ("su", "ua", "au")
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.kinds.append((initial, "blank" if blank else "duplicate" if digest in self.seen else "truncated" if cut else ""))
        self.seen.add(digest)
        self.room -= len(role) + len(text)
        if self.room < 0:
            self.texts = None
        elif self.texts is not None:
            self.texts.append((role, text))

    def result(self) -> tuple:
        cost, labels = shortest_path(self.kinds)
        faults = [f for _, f in self.kinds]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        digest = None
        if self.texts is not None:
            speaker = Speaker(labels)
            for role, text in self.texts:
                speaker.row(role, text)
            digest = speaker.end()
        return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), self.illegal, cost, labels, digest)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, dropped: rows after damage. Nulls of role and text are one space, and so are those of ids and turns in the number that says what a row suffers. Dropped rows stay, marked, so that no conversation is lost."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id"), F.col("turn"), plain("role").alias("role"), plain("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("fault") == 0).alias("dropped"))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


_FOUND = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(conversations: DataFrame, held_chars: int = HELD_CHARS) -> DataFrame:
    """Per conversation: its gaps, faults and illegal neighbours after damage, the cost and labels of the cheapest repair, and the hash of what it gives.

    Rows go by turn (nulls first), rows of one turn by role and text. Null ids are one conversation.
    Rows that repeat count each; other columns are not read; an empty table gives no rows. A conversation
    goes to one task, as its hash runs over all its rows in order, but that task streams: it holds a few
    hundred bytes a row and texts of at most held_chars characters. What is longer than that comes by a second time,
    with its labels in front, and is hashed row by row.
    """
    rows = damaged(conversations).withColumn("trimmed", _trimmed(F.col("text")))
    rows = rows.select("conv_id", "turn", "role", "text", "copy", "dropped", (F.col("trimmed") == "").alias("blank"), (~F.right("trimmed", F.lit(1)).isin(".", "!", "?")).alias("cut"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = object()
        talk, out = None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.conv_id != key:
                    if talk is not None:
                        out.append((key, *talk.result()))
                    key, talk = r.conv_id, Conversation(held_chars)
                if not r.dropped:
                    talk.add(r.turn, r.role, r.text, r.blank, r.cut)
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])
                out = []
        if talk is not None:
            out.append((key, *talk.result()))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    sent = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    told = sent.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "blank", "cut", "dropped").mapInPandas(walk, _FOUND)
    found = materialize(told, "turns")
    kind = conversations.schema["conv_id"].dataType
    long = found.where("repaired_sha256 IS NULL").select(F.col("conv_id").cast(kind).alias("conv_id"), "audit")
    if not long.isEmpty():
        more = found.where("repaired_sha256 IS NULL").drop("repaired_sha256").join(_hashed(rows, long), F.expr("conv_id <=> said_of")).drop("said_of")
        found = found.where("repaired_sha256 IS NOT NULL").unionByName(more)
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def _hashed(rows: DataFrame, long: DataFrame) -> DataFrame:
    """said_of, repaired_sha256: the hash of each long conversation's repaired rows, streamed behind a row that brings its labels."""

    def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, speaker, out = None, None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.audit is not None:
                    if speaker is not None:
                        out.append((key, speaker.end()))
                    key, speaker = r.conv_id, Speaker(r.audit)
                elif not r.dropped:
                    speaker.row(r.role, r.text)
        if speaker is not None:
            out.append((key, speaker.end()))
        if out:
            yield pd.DataFrame(out, columns=["said_of", "repaired_sha256"])

    mine = long.select(F.col("conv_id").alias("_id")).distinct()
    theirs = rows.join(mine, F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi").select("conv_id", "turn", "role", "text", "copy", "dropped", F.lit(None).cast("string").alias("audit"))
    both = theirs.unionByName(long, allowMissingColumns=True).withColumn("first", F.col("audit").isNull())
    sent = both.repartition("conv_id").sortWithinPartitions("conv_id", "first", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    return sent.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text", "dropped", "audit").mapInPandas(speak, "said_of string, repaired_sha256 string")
