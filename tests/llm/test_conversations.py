import hashlib
import heapq
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as cv
from tidemark.llm.queries import op11_conversation_repair

COLUMNS = "conv_id long, turn long, role string, text string, gaps string, audit long, conv string, kind int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    """(conv_id, turn, role, text) after damage, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def brute_conversation(rows):
    """Cheapest edits by search over all scripts, dearer or later in ASCII order last."""
    def place(r):
        return (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest())

    rows = sorted(((c, t, *(" " if x is None else x for x in r)) for c, t, *r in rows), key=place)
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = [c for c in text if BLANK.match(c)]
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(kind)
    initials = [r[2][:1] for r in rows]
    legal = re.compile(r"(s?(ua)+)?")
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, roles, turns = heapq.heappop(heap)
        if at == len(rows) and legal.fullmatch(roles):
            break
        # Scripts of the same rows and role end differ only by cost and audit: the first to come is best.
        if (at, roles[-1:], audit[-1:] == "I") in done:
            continue
        done.add((at, roles[-1:], audit[-1:] == "I"))

        def push(c, e, n, role="", text="", initial=None):
            new = roles + (role[:1] if initial is None else initial)
            if new and not re.fullmatch(r"s?(ua)*u?", new):
                return
            heapq.heappush(heap, (cost + c, audit + e, at + n, new, turns + (((role, text),) if e != "D" else ())))

        for role in ("user", "assistant"):
            push(5, "I", 0, role)
        if at < len(rows):
            _, _, role, text = rows[at]
            push(2, "D", 1)
            if faults[at] in ("", "truncated"):
                more = 5 * (faults[at] == "truncated")
                if role:
                    push(more, "K", 1, role, text)
                for other in ("user", "assistant"):
                    push(more + 1, "R", 1, other, text)
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    text = "\n".join(f"{role}:{text}" for role, text in turns)
    counts = tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), list(turns)


def brute(rows, ids):
    return {c: brute_conversation([r for r in rows if r[0] == c]) for c in ids}


def reported(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = df.collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in found}


def made(seed, convs=60, longest=9):
    texts = ["Fine.", "Well then!", "no end", "", " \t", "Why? ", "Fine.", "é.", "x" * 3000 + "."]
    rows = []
    for conv in range(convs):
        for turn in range(zlib.crc32(f"{seed}:{conv}".encode()) % (longest + 1)):
            h = zlib.crc32(f"{seed}/{conv}/{turn}".encode())
            role = ("user", "assistant", "system", "tool", "", None, "user", "assistant", "usher")[h % 9]
            rows.append((conv, (turn * 2, turn, None)[h // 9 % 3] if h % 5 == 0 else turn, role, (*texts, None)[h // 27 % 10]))
    return rows


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([r + ("g", 1, "c", 9) for r in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize("how", [cv.Repair(), cv.Repair(links_rows=2)], ids=["whole", "in parts"])
def test_repair_agrees_with_search(table, how):
    rows = made(1) + [(None, 0, "user", "a."), (None, None, "assistant", "b."), (None, 1, "user", "b")]
    expected = brute(rows, {r[0] for r in rows})
    found = reported(cv.repair_conversations(table(rows), how))
    assert found == {c: e[0] for c, e in expected.items()}


def test_turns_give_the_digest(table):
    rows = made(2, 40)
    expected = brute(rows, {r[0] for r in rows})
    found: dict = {}
    for r in cv.repaired_turns(table(rows)).orderBy("conv_id", "place").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {c: turns for c, (_, turns) in expected.items() if turns}


def test_query_on_damaged_rows(spark, table, tmp_path):
    rows = made(3, 80, 6) + [(1000 + k, 0, "user", "only one.") for k in range(60)] + [(None, None, None, None)]
    table(rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = reported(op11_conversation_repair(spark, str(tmp_path)))
    expected = brute(brute_damage(rows), {r[0] for r in rows})
    assert found == {c: e[0] for c, e in expected.items()}
    empty = hashlib.sha256(b"").hexdigest()
    assert any(v == (0,) * 6 + ("", empty) for c, v in found.items() if c and c >= 1000)


def test_one_long_conversation_of_copies(spark):
    """Rows repeated without bound: parts are walked back, and no set of texts is kept."""
    n = 30_000
    rows = spark.range(n).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 10 < 8, F.concat(F.col("id").cast("string"), F.lit("."))).otherwise("again.").alias("text"),
    )
    one = cv.repair_conversations(rows, cv.Repair(links_rows=1000)).collect()
    (r,) = one
    assert (r["gaps"], r["blank"], r["truncated"], r["illegal"], r["duplicate"]) == (0, 0, 0, 0, 2 * (n // 10 - 1))
    assert len(r["audit"]) == n and r["cost"] == 2 * r["duplicate"] and set(r["audit"]) == {"K", "D"}


def test_empty_table(spark, table):
    none = spark.createDataFrame([], COLUMNS)
    assert cv.repair_conversations(none).collect() == []
    assert cv.repaired_turns(none).collect() == []
