"""WARC archives: written by Spark, and read back in splits whose record boundaries are proved."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, shared_folder, stored, table
from tidemark.operators.lookups import left_lookup

#: Every record begins with this; files are split and read by it, wherever it stands.
MAGIC = b"WARC/1."
VERSION, END, CLOSING = "WARC/1.1\r\n", "\r\n\r\n", b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The digits of base 32 as `conv` writes them, and as digests do.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """How pages are written: payloads of `least_bytes` or more are kept once and revisited otherwise."""

    least_bytes: int = 0
    date: str = "2000-01-01T00:00:00Z"
    #: So many digests of repeated payloads are sent to every executor, some 30 MB; more are joined by a shuffle.
    sent_digests: int = 250_000


def _base32(sha1: Column) -> Column:
    """The 32 letters of a SHA-1 given as 40 hexadecimal digits: four times ten digits of 4 bits are eight of 5."""
    parts = (F.lpad(F.conv(F.substring(sha1, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4))
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def _records(pages: DataFrame, how: Archive) -> DataFrame:
    """One record per row as the text `value`, but for the blank lines that close it."""
    one_line = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        one_line.alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    size = F.octet_length("html")
    groups = rows.where(size >= how.least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = stored(groups.where("n > 1 and first is not null").select("sha1", "first"))
    if repeated.count() <= how.sent_digests:
        rows = rows.join(F.broadcast(repeated), "sha1", "left")
    else:
        rows = left_lookup(rows, repeated, "sha1", {"first": F.lit(None).cast("long")})
    revisit = F.col("first").isNotNull() & (size >= how.least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = [
        F.lit(f"{VERSION}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(f">\r\nWARC-Date: {how.date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), "url"), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), _base32(F.col("sha1")), F.lit("\r\nX-Payload-Length: "), size.cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.when(revisit, 0).otherwise(size) + len(HTTP)).cast("string"), F.lit(END + HTTP),
    ]
    return rows.select(F.concat(*head, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_warc(pages: DataFrame, folder: str, how: Archive = Archive()) -> None:
    """Writes one record per row of `pages` (page_id, url, html) into WARC files below `folder`.

    The payload is the html in UTF-8, that of a null html is empty. Of equal payloads that of the smallest page_id
    is a response, and the others are revisits that refer to it; rows that repeat this
    id are all responses, and so is a payload that only rows without an id have. Line ends in an url are percent-encoded; other
    columns are ignored. Pages do not move: only digests are grouped, with partial sums, and those
    that repeat come back by a broadcast whose size is counted, or else by a lookup that salts hot keys.
    """
    _records(pages, how).write.option("lineSep", END).text(folder)


@dataclass
class _Split:
    """Candidates of one split: offsets are relative to the split's first byte."""

    file: str
    block: int
    total: int
    at: int = 0
    rows: list[tuple] = field(default_factory=list)
    offsets: array = field(default_factory=lambda: array("q"))
    after: array = field(default_factory=lambda: array("q"))

    def take(self, at: int, piece: bytes, first: bool) -> None:
        """Notes the piece whose magic is at `at` as a candidate, if it goes on as a record may."""
        self.at = at + 2 * len(MAGIC) + len(piece)
        found = None if first and self.block == 0 else _header(piece)
        if found is None:
            return
        header, fields = found
        start = _payload_at(header, fields, piece)
        end = header + int(fields[b"content-length"])
        whole = end + len(CLOSING) <= len(piece)
        if whole and piece[end : end + len(CLOSING)] != CLOSING:
            return
        after = at + len(MAGIC) + end + len(CLOSING)
        self.offsets.append(at)
        self.after.append(after)
        texts = [fields[f].decode("utf-8", "replace") if f in fields else None for f in FIELDS]
        # A payload with magic inside goes on in later pieces and is put together once its record is proved.
        digest = _sha1(piece[start:end]) if whole else None
        self.rows.append((at, after, *texts, at + len(MAGIC) + start, end - start, digest))

    def pointers(self) -> list[tuple[int, int]]:
        """(exit, last) per candidate: the first offset of its chain that is no candidate here, and the chain's last record."""
        place = {o: k for k, o in enumerate(self.offsets)}
        found: list[tuple[int, int]] = [(0, 0)] * len(self.offsets)
        for k in range(len(self.offsets) - 1, -1, -1):
            following = place.get(self.after[k], -1)
            found[k] = found[following] if following > k else (self.after[k], self.offsets[k])
        return found


class _Places:
    """Offsets of pieces within their splits, in file order across Arrow batches."""

    def __init__(self):
        self.split, self.at = None, 0

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes, bool]]:
        """(file, block, offset of the piece's magic, piece, first of its split)."""
        for f, b, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece")), strict=True):
            first = (f, b) != self.split
            if first:
                self.split, self.at = (f, b), 0
            # Only the piece at the start of a file has no magic before it.
            yield f, b, self.at - len(MAGIC), piece, first
            self.at += len(piece) + len(MAGIC)


def _header(piece: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """(length, fields) of the header that a piece begins with, if it is one with a content length."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or piece[1:3] != b"\r\n" or not piece[:1].isdigit():
        return None
    fields = {}
    for line in piece[3:end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields.setdefault(name.strip().lower(), value.strip())
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return None
    return end + 4, fields


FIELDS = (b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest", b"x-payload-length")
CANDIDATE = (
    "file string, block long, at long, after long, exit long, last long, type string, id string, uri string,"
    " refers_to string, declared_digest string, declared_length string, payload_from long, payload_bytes long, digest string"
)
NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]


def _payload_at(header: int, fields: dict[bytes, bytes], piece: bytes) -> int:
    """Where the payload begins in the piece: behind the header and, for HTTP messages, behind theirs."""
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        end = piece.find(b"\r\n\r\n", header, header + int(fields[b"content-length"]))
        return header if end < 0 else end + 4
    return header


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidate_rows(batches: Batches) -> Batches:
    """A row per candidate record, and per split one without offset: the bytes it consumed, those of its file."""
    split = None

    def closed(split: _Split) -> pa.RecordBatch:
        rows = [(*row[:2], exit_, last, *row[2:]) for row, (exit_, last) in zip(split.rows, split.pointers(), strict=True)]
        rows = [(split.file, split.block, *row) for row in rows]
        rows.append((split.file, split.block, None, split.at, split.total, *[None] * 10))
        kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in CANDIDATE.split(", ")]
        return table({n: pa.array(c, k) for n, c, k in zip(NAMES, zip(*rows, strict=True), kinds, strict=True)})

    places = _Places()
    for batch in batches:
        totals = batch.column("total").to_pylist()
        for (file, block, at, piece, first), total in zip(places.of(batch), totals, strict=True):
            if first:
                if split is not None:
                    yield closed(split)
                split = _Split(file, block, total)
            split.take(at, piece, first)
    if split is not None:
        yield closed(split)


def _split_pieces(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(folder)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("total"),
        F.col("value").cast("binary").alias("piece"),
    )


def _reached(pointers: DataFrame) -> DataFrame:
    """(file, at): entries reachable from offset 0 of their file, by pointer jumping over (file, at, to).

    After k rounds the first 2^k entries of a chain are known and every pointer spans as many, so the
    rounds are the logarithm of the splits of the longest file.
    """
    known = stored(pointers.where("at = 0").select("file", "at"))
    n = known.count()
    while n:
        steps = pointers.select(F.col("file"), F.col("at"), F.col("to"))
        ahead = known.join(steps, ["file", "at"]).select("file", F.col("to").alias("at"))
        known = stored(known.unionByName(ahead.join(pointers.select("file", "at"), ["file", "at"], "left_semi")).distinct())
        n, before = known.count(), n
        if n == before:
            break
        far = pointers.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        pointers = stored(steps.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")))
    return known


def _on_chain(batches: Batches) -> Batches:
    """Of a split's candidates in order, those on the chain from its entry."""
    split, expected = None, None
    for batch in batches:
        keep = []
        for k, (f, b, at, after, entry) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "block", "at", "after", "entry")), strict=True)):
            if (f, b) != split:
                split, expected = (f, b), entry
            if at == expected:
                keep.append(k)
                expected = after
        yield batch.select(KEPT).take(pa.array(keep, pa.int64()))


KEPT = [n for n in NAMES if n not in ("exit", "last")]
RECORD = ", ".join(c for c in CANDIDATE.split(", ") if c.split()[0] in KEPT)


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the WARC files (1.x, uncompressed) below `folder`.

    (file, at, type, id, uri, refers_to, declared_digest, declared_length, payload_bytes, digest) and with `payloads` the
    payload itself; `at` is the record's offset in its file, `payload_bytes` and `digest` are of the payload that is there.

    Files are read in Spark's splits. Every place with the magic that goes on as a header with a content
    length is a candidate for a record, and names where the next one has to start. A split
    contracts its candidates' chains to the offset where they leave it; offsets become absolute by sums over the
    splits before. Pointer jumping then finds the entries of splits that are reachable from the start of the file,
    and a candidate counts only if its split's entry leads to it. A record written inside a payload never does.
    A chain that breaks off (a record that is cut or not closed by blank lines) ends the file's records before it. Payloads with the magic in them are put
    together from their pieces in a second read. Empty files and folders without any have no records.
    """
    pieces = _split_pieces(spark, folder)
    found = stored(pieces.mapInArrow(_candidate_rows, CANDIDATE))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("after").over(before), F.lit(0))
    splits = stored(found.where("at is null").select("file", "block", base.alias("base"), F.col("exit").alias("total")))
    moved = ("at", "after", "exit", "last", "payload_from")
    shifted = {c: F.col(c) + F.col("base") for c in moved}
    candidates = found.where("at is not null").join(splits, ["file", "block"]).withColumns(shifted).where("after <= total")

    # Chains are entered at offset 0 or where another split's chain leaves.
    exits = candidates.select("file", F.col("exit").alias("at")).distinct()
    doors = exits.unionByName(candidates.where("at = 0").select("file", "at")).distinct()
    entries = stored(candidates.join(doors, ["file", "at"], "left_semi").select("file", "block", "at", F.col("exit").alias("to"), "last"))
    reached = entries.join(_reached(entries.select("file", "at", "to")), ["file", "at"], "left_semi")
    entered = stored(reached.select("file", "block", F.col("at").alias("entry"), "last"))

    dealt = candidates.join(entered.select("file", "block", "entry"), ["file", "block"])
    ordered = dealt.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    records = stored(ordered.select(*KEPT, "entry").mapInArrow(_on_chain, RECORD))

    parts = _payloads(pieces, records, splits, payloads)
    own = [c for c in KEPT if c not in ("block", "after", "payload_from", "payload_bytes", "digest")]
    told = records.select(*own, F.col("payload_bytes").alias("claimed"), F.col("digest").alias("told"))
    joined = told.join(parts, ["file", "at"], "left")
    wrong = F.raise_error(F.lit("a payload was not found whole: the files or their splits changed between two reads"))
    checked = F.when(F.col("told").isNull() & ~F.col("size").eqNullSafe(F.col("claimed")), wrong.cast("long")).otherwise(F.col("claimed"))
    joined = joined.where("told is not null or closed is null or closed")
    columns = [*own, checked.alias("payload_bytes"), F.coalesce("told", "digest").alias("digest")]
    return joined.select(*columns, *(["payload"] if payloads else []))


PIECE = "file string, block long, at long, bytes binary"
PART = "file string, record long, at long, bytes binary"


def _placed_rows(batches: Batches) -> Batches:
    """Each piece with the magic before it and its offset in its split."""
    places = _Places()
    for batch in batches:
        out = [
            (f, b, 0, piece) if first and b == 0 else (f, b, at, MAGIC + piece)
            for f, b, at, piece, first in places.of(batch)
        ]
        columns = zip(*out, strict=True) if out else ((),) * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield table({c.split()[0]: pa.array(v, k) for c, v, k in zip(PIECE.split(", "), columns, kinds, strict=True)})


def _part_rows(batches: Batches) -> Batches:
    """Rows of a split in order: a mark of a wanted payload goes ahead of its pieces. The payload's bytes in each piece."""
    split, record, low, high = None, None, 0, 0
    columns = ("file", "block", "at", "bytes", "record", "from", "to")
    for batch in batches:
        out = []
        for f, b, at, data, mark, start, end in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if (f, b) != split:
                split, record = (f, b), None
            if mark is not None:
                record, low, high = mark, start, end
            elif record is not None:
                a, z = max(low, at), min(high, at + len(data))
                if a < z:
                    out.append((f, record, a, data[a - at : z - at]))
        found = zip(*out, strict=True) if out else ((),) * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield table({c.split()[0]: pa.array(v, k) for c, v, k in zip(PART.split(", "), found, kinds, strict=True)})


def _joined_rows(payloads: bool):
    def rows(batches: Batches) -> Batches:
        now, size, digest, held, tail = None, 0, hashlib.sha1(), [], b""

        def closed() -> pa.RecordBatch:
            columns = {"file": pa.array([now[0]]), "at": pa.array([now[1]], pa.int64()), "size": pa.array([size - len(tail)], pa.int64())}
            columns["digest"] = pa.array([base64.b32encode(digest.digest()).decode()])
            columns["closed"] = pa.array([tail == CLOSING])
            return table(columns | ({"payload": pa.array([b"".join(held)], pa.binary())} if payloads else {}))

        for batch in batches:
            for f, record, data in zip(*(batch.column(c).to_pylist() for c in ("file", "record", "bytes")), strict=True):
                if (f, record) != now:
                    if now is not None:
                        yield closed()
                    now, size, digest, held, tail = (f, record), 0, hashlib.sha1(), [], b""
                size += len(data)
                # The last bytes so far may be the closing ones, which are no part of the payload.
                data, tail = (tail + data)[: -len(CLOSING)], (tail + data)[-len(CLOSING) :]
                digest.update(data)
                if payloads:
                    held.append(data)
        if now is not None:
            yield closed()

    return rows


def _payloads(pieces: DataFrame, records: DataFrame, splits: DataFrame, all_of_them: bool) -> DataFrame:
    """(file, at, size, digest, closed[, payload]) of records whose payload goes on beyond its piece, or of all that have one.

    Pieces go to their split's marks: those of its own records, and that of the last record before it
    if its payload reaches into the split. Only splits with marks are read on.
    """
    kind = "file string, at long, size long, digest string, closed boolean" + (", payload binary" if all_of_them else "")
    needed = records if all_of_them else records.where("digest is null")
    if needed.isEmpty():
        return records.sparkSession.createDataFrame([], kind)
    end = F.col("payload_from") + F.col("payload_bytes") + len(CLOSING)
    marks = needed.select("file", "block", F.struct(F.col("at").alias("record"), F.col("payload_from").alias("from"), end.alias("to")).alias("w"))
    newest = marks.groupBy("file", "block").agg(F.max("w").alias("newest"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last("newest", ignorenulls=True).over(before)
    reach = splits.drop("total").join(newest, ["file", "block"], "left").withColumn("open", open_)
    reach = reach.withColumn("open", F.when(F.col("open.to") > F.col("base") - len(MAGIC), F.col("open")))
    reach = stored(reach.where("newest is not null or open is not null"))
    opened = reach.where("open is not null").select("file", "block", (F.col("base") - len(MAGIC)).alias("at"), F.col("open").alias("w"))
    marks = marks.select("file", "block", F.col("w.record").alias("at"), "w").unionByName(opened)
    placed = pieces.mapInArrow(_placed_rows, PIECE).join(reach.select("file", "block", "base"), ["file", "block"])
    empty = F.lit(None).cast("struct<record:bigint,from:bigint,to:bigint>")
    both = placed.select("file", "block", (F.col("at") + F.col("base")).alias("at"), F.lit(1).alias("kind"), "bytes", empty.alias("w")).unionByName(
        marks.select("file", "block", "at", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("bytes"), "w")
    )
    dealt = both.repartition("file", "block").sortWithinPartitions("file", "block", "at", "kind", "w")
    parts = dealt.select("file", "block", "at", "bytes", "w.record", "w.from", "w.to").mapInArrow(_part_rows, PART)
    ordered = parts.repartition("file", "record").sortWithinPartitions("file", "record", "at")
    return ordered.mapInArrow(_joined_rows(all_of_them), kind)


def archive_pages(pages: DataFrame, how: Archive = Archive(), folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archive written of `pages`.

    The bytes and digest of a response are those of the payload that was read, those of a revisit
    the ones that its record names.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    write_warc(pages, folder, how)
    records = read_warc(spark, folder)
    number = r"^<urn:page:(-?[0-9]+)>$"

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, number, 1), F.lit("")).cast("long")

    revisit = F.col("type") == "revisit"
    return records.select(
        page("id").alias("page_id"),
        F.when(revisit, F.col("declared_length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("declared_digest", ":", -1)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
