import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.queries import op13_warc

PAGES = "page_id long, url string, html string, digest string, size long, at long, first long"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages_of(spark, rows, partitions=3):
    return spark.createDataFrame([r + ("d", 1, 2, 3) for r in rows], PAGES).repartition(partitions)


def brute(rows, least=0):
    first: dict = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        to = first.get(payload)
        revisit = to is not None and page != to and len(payload) >= least
        out.append((page, len(payload), sha(payload), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=repr)


def record(payload, kind="response", extra=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:99>\r\n{extra}Content-Length: {len(payload.encode())}\r\n\r\n{payload}\r\n\r\n"


#: Payloads with the magic, with whole records, with records that claim too much, and with ends of records.
HOSTILE = [
    (20, "http://h/\r\nWARC-Type: x", "<p>WARC/1.1\r\n</p>"),
    (21, None, "before " + record("<p>inner</p>") * 5 + " after"),
    (22, "u", record("x", extra="X: WARC/1.1\r\n")),
    (23, "u", "WARC/1.0\r\nContent-Length: 5000\r\n\r\nshort"),
    (24, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    (25, "u", "WARC/1." * 40),
    (26, "u", "é\U0001f600 WARC/1.\r\n" + "ü" * 900),
    (27, "u", "before " + record("<p>inner</p>") * 5 + " after"),
    (28, "u", record(record(record("deep")))),
]
PLAIN = [
    (None, None, None), (1, "u", None), (2, "u", ""), (3, "u", "<p>a</p>"), (4, None, "<p>a</p>"), (5, "u", "<p>b</p>"),
    (5, "v", "<p>b</p>"), (6, "u", "<p>b</p>"), (None, "u", "<p>b</p>"), (None, "w", "only without id"), (7, "u", "x" * 7_000), (-3, "u", "x" * 7_000),
]


@pytest.fixture(params=["128m", "300"])
def split_bytes(spark, request):
    """Splits that hold whole files, and splits smaller than most records."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, request.param)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, split_bytes, least):
    rows = PLAIN + HOSTILE + [(100 + k, "u", f"<p>{k % 7}</p>" * (k % 13)) for k in range(60)]
    assert found(warc.archive_pages(pages_of(spark, rows), warc.Archive(least_bytes=least))) == brute(rows, least)


def test_lookup_instead_of_broadcast(spark):
    rows = PLAIN + [(100 + k, "u", "hot") for k in range(300)]
    assert found(warc.archive_pages(pages_of(spark, rows), warc.Archive(sent_digests=0))) == brute(rows)


def test_payloads_come_back(spark, split_bytes, tmp_path):
    rows = [r for r in PLAIN + HOSTILE if r[0] is not None]
    warc.write_warc(pages_of(spark, rows, 2), f"{tmp_path}/a", warc.Archive(least_bytes=1 << 30))
    got = warc.read_warc(spark, f"{tmp_path}/a", payloads=True).collect()
    assert sorted((r["id"], bytes(r["payload"] or b"")) for r in got) == sorted((f"<urn:page:{p}>", (h or "").encode()) for p, _, h in rows)
    assert all(r["digest"] == sha(bytes(r["payload"] or b"")) and r["declared_digest"] == "sha1:" + r["digest"] for r in got)
    assert {r["uri"] for r in got} >= {"http://h/%0D%0AWARC-Type: x"}


def sequential(data):
    """Offsets of the records of a file, read from its start; stops where the chain breaks."""
    at, out = 0, []
    while data[at : at + 7] == b"WARC/1.":
        end = data.find(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:] if b": " in x)
        if end < 0 or b"Content-Length" not in fields:
            break
        size = int(fields[b"Content-Length"])
        payload = data[end + 4 : end + 4 + size]
        if len(payload) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            break
        out.append((at, size, sha(payload)))
        at = end + 8 + size
    return out


def test_foreign_files_agree_with_reading_from_the_start(spark, split_bytes, tmp_path):
    pick, expected = random.Random(5), []
    (tmp_path / "w").mkdir()
    for k in range(6):
        parts = [record("".join(pick.choice(["WARC/1.1\r\n", "a" * pick.randint(0, 90), record("in"), "\r\n\r\n", "WARC/1"]) for _ in range(pick.randint(0, 9)))) for _ in range(40)]
        data = "".join(parts).encode()
        data = (data, data[:-3], data + b"WARC/1.1\r\nrubbish", data[:1500] + b"#" + data[1500:], b"no archive " + data, b"")[k]
        (tmp_path / "w" / f"f{k}.warc").write_bytes(data)
        expected += [(f"f{k}.warc", *r) for r in sequential(data)]
    rows = warc.read_warc(spark, str(tmp_path / "w")).select(F.regexp_extract("file", "[^/]+$", 0), "at", "payload_bytes", "digest")
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


def test_query_and_empty_table(spark, tmp_path):
    rows = PLAIN[1:4] + HOSTILE
    pages_of(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    assert found(op13_warc(spark, str(tmp_path))) == brute(rows)
    assert warc.archive_pages(pages_of(spark, rows).where("false")).collect() == []
