"""Conversation structure repair: the cheapest edits that make roles alternate, streamed in turn order."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: What has been put out so far: nothing, or it ends with a system, user or assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next turn that may be inserted or given another role, and that role.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What closes the conversation from a state: text of the audit and cost come from its length.
CLOSE = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
SOUND, TRUNCATED, REMOVED = range(3)
FAR = 1 << 60


@dataclass(frozen=True)
class Repair:
    """Costs of the edits, and how many rows' links a task holds before it puts them out."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    links_rows: int = 65_536


def _moves(initial: str, fault: int, how: Repair) -> Iterator[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of one row. A deletion comes before an insertion, and two insertions
    before a row only lead to where none would, so neither of those is listed."""
    for state in range(4):
        yield state, state, how.delete, "D"
        if fault != REMOVED:
            for before, edits in ((state, ""), (NEXT[state], "I")):
                cost = how.insert * len(edits) + how.truncated * (fault == TRUNCATED)
                if (before, initial) in KEPT:
                    yield state, KEPT[before, initial], cost, edits + "K"
                yield state, NEXT[before], cost + how.rerole, edits + "R"


#: Per target state, what may lead to it; a link names one by its place, in four bits.
SOURCES = [
    sorted({(s, e) for i in ("s", "u", "a", "") for s, to, _, e in _moves(i, SOUND, Repair()) if to == t}) for t in range(4)
]
NO_LINK = 15


class Edits:
    """Cheapest ways to each state over the rows seen so far, ties to the ASCII-least edits.

    Of two ways that have consumed the same rows neither is the beginning of the other, so their
    order stays whatever follows. Four costs and four ranks are therefore all there is to
    carry from row to row, and up to their common part they take few values: a step is looked up.
    """

    def __init__(self, how: Repair):
        self.how, self.cost, self.state = how, 0, ((0, FAR, FAR, FAR), (0, 9, 9, 9))
        self.step = lru_cache(maxsize=1 << 16)(self._step)

    def start(self) -> None:
        self.cost, self.state = 0, ((0, FAR, FAR, FAR), (0, 9, 9, 9))

    def _step(self, state: tuple, initial: str, fault: int) -> tuple[tuple, int, int, list]:
        costs, ranks = state
        best: dict[int, tuple] = {}
        for s, t, cost, edits in _moves(initial, fault, self.how):
            if costs[s] < FAR:
                best[t] = min(best.get(t, (FAR,)), (costs[s] + cost, ranks[s], edits, s))
        least = min(b[0] for b in best.values())
        order = sorted(best, key=lambda t: best[t][1:3])
        after = tuple(best[t][0] - least if t in best else FAR for t in range(4))
        link = 0
        for t in range(4):
            at = SOURCES[t].index((best[t][3], best[t][2])) if t in best else NO_LINK
            link |= at << (4 * t)
        moves = [(t, best[t][3], best[t][2]) for t in sorted(best)]
        return (after, tuple(order.index(t) if t in best else 9 for t in range(4))), least, link, moves

    def take(self, initial: str, fault: int) -> tuple[int, list]:
        """Consumes a row; its link, and (to, from, edits) of the cheapest ways."""
        self.state, more, link, moves = self.step(self.state, initial, fault)
        self.cost += more
        return link, moves

    def end(self) -> tuple[int, int]:
        """(cost, last state before the closing insertions) of the cheapest whole way."""
        costs, ranks = self.state
        rest, _, state = min((costs[s] + self.how.insert * len(CLOSE[s]), ranks[s], s) for s in range(4))
        return self.cost + rest, state


def edits_back(links: array, state: int) -> tuple[str, int]:
    """The edits of the rows behind `links` that lead to `state`, and the state before them."""
    found = []
    for link in reversed(links):
        state, edits = SOURCES[state][(link >> (4 * state)) & 15]
        found.append(edits)
    return "".join(reversed(found)), state


class Texts:
    """The digest of the repaired text on the cheapest way to each state."""

    def __init__(self):
        self.to = {NOTHING: hashlib.sha256()}

    def follow(self, moves: list, role: bytes, text: bytes) -> None:
        found = {}
        for to, state, edits in moves:
            digest = self.to[state]
            if edits != "D":
                digest = digest.copy()
                for _, _, turn_role, turn_text in turns_of(edits, state, role, text):
                    digest.update((b"" if state == NOTHING else b"\n") + turn_role + b":")
                    digest.update(turn_text)
                    state = to
            found[to] = digest
        self.to = found

    def close(self, state: int) -> str:
        digest = self.to[state].copy()
        for _, _, role, _ in turns_of(CLOSE[state], state, b"", b""):
            digest.update(b"\n" + role + b":")
        return digest.hexdigest()


def turns_of(edits: str, state: int, role: bytes, text: bytes) -> Iterator[tuple[str, int, bytes, bytes]]:
    """(edit, state after it, role, text) of each turn that `edits` put out for one row; none for a deletion."""
    for e in edits:
        if e == "I" or e == "R":
            state = NEXT[state]
            yield e, state, ROLE[state], b"" if e == "I" else text
        elif e == "K":
            state = KEPT[state, role[:1].decode("latin-1")]
            yield e, state, role, text


def _ordered(conversations: DataFrame, present: Column) -> DataFrame:
    """All rows of a conversation in one task, by turn, with a mark before each first of its role and text.

    Only the marks, a digest each, are grouped beforehand, so repeated texts of a conversation
    need neither a set in memory nor a second shuffle of the texts. Rows that are not `present` name their conversation.
    """
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"),
        turn.isNotNull().alias("timed"),
        F.coalesce(turn, F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce(present, F.lit(True)).alias("present"),
    )
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", REMOVED).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    rows = rows.select("conv", "timed", "turn", "role", F.unhex(F.md5("text")).alias("digest"), fault.alias("fault"), "present", "text")
    place = F.min(F.struct("timed", "turn"))
    firsts = rows.where(F.col("present") & (F.col("fault") != REMOVED)).groupBy("conv", "role", "digest").agg(place.alias("p"))
    marks = firsts.select("conv", "p.timed", "p.turn", "role", "digest", F.lit(1).alias("kind"), F.lit(0).alias("fault"), F.lit(b"").alias("text"))
    seen = F.when(F.col("present"), 2).otherwise(0)
    text = F.when(F.col("present"), F.col("text").cast("binary")).otherwise(F.lit(b""))
    both = rows.select("conv", "timed", "turn", "role", "digest", seen.alias("kind"), "fault", text.alias("text")).unionByName(marks)
    return both.repartition("conv").sortWithinPartitions("conv", "timed", "turn", "role", "digest", "kind")


REPORT = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string, part int, links binary, state int"
)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _faults(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv, timed, turn, role, text, fault, duplicate) of each present row; (conv,) of an absent one."""
    mark = None
    columns = ("conv", "timed", "turn", "role", "digest", "kind", "fault", "text")
    for frame in frames:
        for conv, timed, turn, role, digest, kind, fault, text in zip(*(frame[c].tolist() for c in columns), strict=True):
            if kind == 1:
                mark = (conv, timed, turn, role, digest)
            elif kind == 0:
                yield (conv,)
            else:
                first = mark == (conv, timed, turn, role, digest)
                if first:
                    mark = None
                yield conv, timed, turn, role, text, fault, fault != REMOVED and not first


class _Conversation:
    """What is carried from row to row of one conversation."""

    def __init__(self, conv: str | None, edits: Edits):
        self.conv, self.edits, self.texts, self.links = conv, edits, Texts(), array("H")
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.parts = self.turns = 0
        self.least = self.most = None
        self.before = ""
        edits.start()

    def take(self, timed: bool, turn: int, role: str, text: bytes, fault: int, duplicate: bool) -> None:
        if timed and turn != self.most:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.illegal += self.rows > 0 and self.before + role[:1] not in LEGAL
        self.before, self.rows = role[:1], self.rows + 1
        self.blank += fault == REMOVED
        self.duplicate += duplicate
        self.truncated += fault == TRUNCATED and not duplicate
        link, moves = self.edits.take(role[:1], REMOVED if duplicate else fault)
        self.links.append(link)
        self.texts.follow(moves, role.encode("utf-8", "surrogatepass"), text)

    def spilled(self) -> tuple:
        row = (self.conv, *[0] * 6, None, None, self.parts, self.links.tobytes(), 0)
        self.parts, self.links = self.parts + 1, array("H")
        return row

    def report(self) -> tuple:
        cost, state = self.edits.end()
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, 2**63 - 1)
        counts = (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        digest = self.texts.close(state)
        if self.parts:
            return *counts, None, digest, self.parts, self.links.tobytes(), state
        return *counts, edits_back(self.links, state)[0] + CLOSE[state], digest, 0, None, state


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _report_rows(how: Repair):
    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        edits, now = Edits(how), None
        for conv, *row in _faults(frames):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now.report()
                now = _Conversation(conv, edits)
            if row:
                now.take(*row)
                if len(now.links) >= how.links_rows:
                    yield now.spilled()
        if now is not None:
            yield now.report()

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in stream(frames):
            out.append(row)
            if len(out) >= 1000 or row[10]:
                yield _frame(out, REPORT)
                out.clear()
        if out:
            yield _frame(out, REPORT)

    return rows


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the links of each conversation back, last part first; the edits of each part."""
    conv, state = (), 0
    for frame in frames:
        out = []
        for name, part, links, last in zip(frame["conv"], frame["part"], frame["links"], frame["state"], strict=True):
            tail = ""
            if (name,) != conv:
                conv, state, tail = (name,), last, CLOSE[last]
            found, state = edits_back(array("H", links), state)
            out.append((name, part, found + tail))
        yield _frame(out, "conv string, part int, piece string")


def repair_conversations(conversations: DataFrame, how: Repair = Repair(), present: Column | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `conversations` has conv_id, turn, role and text; other columns are ignored. Rows of a
    conversation go by turn, nulls first, then by role and the MD5 of their text; a null role or
    text counts as one space, a null conv_id is a conversation like any other. Rows for which `present` is false only
    name their conversation, which is reported with zeros if it has no others. A row whose role is
    empty or begins otherwise than s, u or a cannot be kept as it is.

    One shuffle brings each conversation to one task in order. There a row is consumed at a time: the
    task carries four costs, four ranks and four digests across Arrow batches, and two bytes of links a row. Beyond
    `links_rows` rows the links are put out as a part; parts are walked back in a second pass. So a
    conversation of any length takes bounded memory but for its audit, which is one value of the result;
    its rows pass through one task, because the digest of its text can only be made in order.
    """
    ordered = _ordered(conversations, F.lit(True) if present is None else present)
    found = stored(ordered.mapInPandas(_report_rows(how), REPORT))
    parts = found.where(F.col("links").isNotNull()).select("conv", "part", "links", "state")
    pieces = parts.repartition("conv").sortWithinPartitions("conv", F.desc("part")).mapInPandas(_pieces, "conv string, part int, piece string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "")
    audits = pieces.groupBy(F.col("conv").alias("c")).agg(joined.alias("long_audit"))
    reports = found.where(F.col("repaired_sha256").isNotNull()).join(audits, F.col("conv").eqNullSafe(F.col("c")), "left")
    kind = conversations.schema["conv_id"].dataType
    return reports.select(
        F.col("conv").cast(kind).alias("conv_id"), *COUNTS, F.coalesce("audit", "long_audit").alias("audit"), "repaired_sha256"
    )


TURNS = "conv string, place long, edit string, role string, text string"


def _turn_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    conv, audit, at, place, state = (), "", 0, 0, NOTHING

    def put(edits: str, role: bytes, text: bytes) -> None:
        nonlocal place, state
        for e, after, turn_role, turn_text in turns_of(edits, state, role, text):
            out.append((conv[0], place, e, turn_role.decode("utf-8", "replace"), turn_text.decode("utf-8", "replace")))
            place, state = place + 1, after

    for frame in frames:
        for name, kind, role, text in zip(frame["conv"], frame["kind"], frame["role"], frame["text"], strict=True):
            if kind == -1:
                put(audit[at:], b"", b"")
                conv, audit, at, place, state = (name,), text.decode("ascii"), 0, 0, NOTHING
            elif kind == 2:
                to = at
                while audit[to] == "I":
                    to += 1
                put(audit[at : to + 1], role.encode("utf-8", "surrogatepass"), text)
                at = to + 1
            if len(out) >= 1000:
                yield _frame(out, TURNS)
                out.clear()
    put(audit[at:], b"", b"")
    yield _frame(out, TURNS)


def repaired_turns(conversations: DataFrame, how: Repair = Repair(), present: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, from place 0.

    `edit` is K, R or I for a turn kept, given another role or inserted. The audit of a conversation
    goes ahead of its rows in the order of `repair_conversations`, and tells what becomes of each.
    """
    given = F.lit(True) if present is None else present
    report = repair_conversations(conversations, how, present)
    heads = report.select(
        F.col("conv_id").cast("string").alias("conv"), F.lit(False).alias("timed"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("digest"), F.lit(-1).alias("kind"), F.lit(0).alias("fault"), F.col("audit").cast("binary").alias("text"),
    )
    rows = _ordered(conversations, given).where("kind = 2").unionByName(heads)
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("kind") >= 0, "timed", "turn", "role", "digest")
    turns = ordered.select("conv", "kind", "role", "text").mapInPandas(_turn_rows, TURNS)
    return turns.withColumnRenamed("conv", "conv_id").withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of `conv_id:turn` modulo 20; `present` is false for dropped ones.

    0 drops a row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes its role user. Nulls count as one space.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("present"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
