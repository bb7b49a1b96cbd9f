"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer gives every task files of its own in the shared folder and lists them in a manifest table that Spark commits;
files of attempts that were lost are not listed. The reader takes one file to a task and reads it in pieces. Where
a record fails a check (version line, header, length, block or payload digest, gzip checksum), it searches for the next
gzip member or version line that passes, goes on from there and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwatch.llm.common import stored, table
from wardwatch.session import scratch_path

SEGMENT = 64 << 20  # bytes after which a task begins a new file
PIECE = 1 << 20  # bytes read or inflated at once
SMALL = 4 * PIECE  # inflated bytes of a member that is held; larger ones pass through a window
HEADER = 1 << 16  # bytes of a record read at first; more as long as its header goes on
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID = "<urn:page:{}>"

MANIFEST = "path string, records long, bytes long"
FOUND = (
    "kind string, path string, offset long, length long, reason string, record_type string, record_id string, target string,"
    " refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def digest_of(data: bytes) -> str:
    """SHA-1 in base32, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing --------------------------------------------------------------------------------------------------------


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, original: bool) -> bytes:
    """One record. A revisit keeps the HTTP header of the full payload, length included, and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if original else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if original else 'revisit'}", f"WARC-Record-ID: {ID.format('' if page is None else page)}",
        f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if not original:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {ID.format(first)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+://?", uri) else (fs.LocalFileSystem(), uri)


def archive_writer(folder: str, segment: int, compress: bool):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, made, number = None, None, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name = f"part-{stem}-{number:04d}.warc" + ".gz" * compress
                    out, made, number = store.open_output_stream(f"{base}/{name}", compression=None), [f"{folder}/{name}", 0, 0], number + 1
                page = None if row.page is None or pd.isna(row.page) else int(row.page)
                first = None if row.first is None or pd.isna(row.first) else int(row.first)
                data = record_bytes(page, row.url, (row.html or "").encode(), row.digest, first, bool(row.original))
                if compress:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                out.write(data)
                made[1], made[2] = made[1] + 1, made[2] + len(data)
                if made[2] >= segment:
                    out.close()
                    out = None
                    yield pd.DataFrame([made], columns=["path", "records", "bytes"])
        if out is not None:
            out.close()
            yield pd.DataFrame([made], columns=["path", "records", "bytes"])

    return over


def write_archives(pages: DataFrame, folder: str, least: int = 0, segment: int = SEGMENT, compress: bool = True) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns the committed manifest ``path, records, bytes``.

    Of equal payloads with at least ``least`` bytes the record with the largest ``page_id`` is the response (null is
    smallest; rows that repeat that id are the same page and all responses), the others revisit it. The responses'
    ids are aggregated before the shuffle and joined back, where Spark splits a payload with very many pages.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("sha"),
    )
    first = stored(rows.groupBy(F.col("sha").alias("of")).agg(F.max("page").alias("first")), "first-pages")
    long_enough = F.octet_length("html") >= least
    chosen = rows.join(first, F.col("sha") == F.col("of")).select(
        "page", "url", "html", F.col("sha"), "first", (~long_enough | F.col("page").eqNullSafe(F.col("first"))).alias("original")
    )
    write = archive_writer(folder, segment, compress)

    def with_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from write(b.assign(digest=[base64.b32encode(bytes.fromhex(s)).decode() for s in b["sha"]]) for b in batches)

    ids = chosen.withColumns({"page": F.col("page").cast("string"), "first": F.col("first").cast("string")})
    return stored(ids.mapInPandas(with_digest, MANIFEST), "warc-manifest")


# --- reading --------------------------------------------------------------------------------------------------------


class Failed(Exception):
    pass


class Record(NamedTuple):
    headers: dict[str, str]
    end: int  # in the bytes that were parsed
    size: int  # of the payload
    digest: str  # of the payload
    lead: bytes  # the first bytes of a block that is an HTTP message
    payload: bytes | None  # if it was asked for


class Window:
    """Random access to a file through one piece at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def read(self, at: int, count: int) -> bytes:
        count = max(0, min(count, self.size - at))
        if not (self.start <= at and at + count <= self.start + len(self.data)):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(count, PIECE))
        return self.data[at - self.start : at - self.start + count]

    def peek(self, at: int, count: int) -> bytes:
        """As ``read``, but the piece at hand stays."""
        if self.start <= at and at + count <= self.start + len(self.data):
            return self.data[at - self.start : at - self.start + count]
        self.file.seek(at)
        return self.file.read(count)

    def some(self, at: int, most: int) -> bytes:
        """At least one and at most so many bytes, unless the file ends."""
        if not self.start <= at < self.start + len(self.data):
            return self.read(at, most)
        return self.data[at - self.start : at - self.start + most]

    def find(self, at: int) -> int:
        """The next place, from ``at`` on, that looks like a member or a version line at a line's start; else the end."""
        while at < self.size:
            data = self.read(at, min(PIECE, self.size - at))
            hits = [i for i in (data.find(MEMBER), data.find(VERSION)) if i >= 0]
            if hits:
                return at + min(hits)
            if at + len(data) >= self.size:
                return self.size
            at += len(data) - len(VERSION) + 1
        return self.size


class Held:
    """Bytes in memory, with a window's access."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, count: int) -> bytes:
        return self.data[at : at + count]

    peek = read

    def mark(self, at: int) -> None:
        pass

    def find(self, at: int) -> int:
        place = self.data.find(VERSION, at)
        return self.size if place < 0 else place


class Inflater:
    """The bytes of a member in order, as far as they can be inflated, in bounded pieces."""

    def __init__(self, window: Window, at: int):
        self.window, self.place, self.step = window, at, 1 << 12
        self.unpack, self.failure = zlib.decompressobj(31), None

    def copy(self) -> Inflater:
        other = Inflater(self.window, self.place)
        other.unpack, other.failure, other.step = self.unpack.copy(), self.failure, self.step
        return other

    def more(self, most: int | None = None) -> bytes:
        """The next bytes, ``PIECE`` or ``most`` at most; none at the member's end or where it fails (``failure`` then says why)."""
        while not self.unpack.eof and self.failure is None:
            data = self.window.some(self.place, self.step) if self.place < self.window.size else b""
            before = self.unpack.copy()
            try:
                out = self.unpack.decompress(data, most or PIECE)
            except zlib.error:  # too far: halve the step, so that all sound bytes come out
                self.unpack, self.step = before, len(data) // 2
                if not self.step:
                    self.failure = "member checksum or data"
                continue
            rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            self.place += len(data) - len(rest)
            self.step = min(2 * self.step, PIECE)
            if out:
                return out
            if not data and not self.unpack.eof:
                self.failure = "member cut short"
        return b""


class Inflated:
    """The first ``size`` inflated bytes of a member, from the mark on, through a bounded window.

    Going back starts at the mark again, with the inflater as it was there. ``peek`` can't jump: it has to inflate.
    """

    def __init__(self, window: Window, at: int, size: int):
        self.size = size
        self.marked = (Inflater(window, at), 0, b"")
        self._return()

    def _return(self) -> None:
        inflater, self.start, self.data = self.marked
        self.inflater = inflater.copy()

    def mark(self, at: int) -> None:
        """Nothing before ``at`` is read again."""
        self.read(at, 1)
        self.data, self.start = self.data[at - self.start :], at
        self.marked = (self.inflater.copy(), self.start, self.data)

    def read(self, at: int, count: int) -> bytes:
        if at < self.start:
            self._return()
        count = max(0, min(count, self.size - at))
        while self.start + len(self.data) < at + count:
            more = self.inflater.more()
            if not more:
                break
            if at > self.start:  # what lies before it is not needed again, but from the mark
                gone = min(at - self.start, len(self.data))
                self.start, self.data = self.start + gone, self.data[gone:]
            self.data += more
        return self.data[max(at - self.start, 0) : max(at - self.start, 0) + count]

    def find(self, at: int) -> int:
        while at < self.size:
            data = self.read(at, PIECE)
            place = data.find(VERSION)
            if place >= 0:
                return at + place
            if at + len(data) >= self.size or not data:
                return self.size
            at += len(data) - len(VERSION) + 1
        return self.size


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        raise Failed("version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Failed("header line")
        headers.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")) or "warc-type" not in headers:
        raise Failed("header fields")
    return headers


def base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def scan_block(source, headers: dict[str, str], start: int, size: int, end: int, keep: bool) -> Record:
    """The record whose block lies there, read in pieces; digests that the header declares must agree."""
    http = headers.get("content-type", "").startswith("application/http")
    block, body, held, length, lead, last, inside, at = hashlib.sha1(), hashlib.sha1(), [], 0, b"", b"", not http, start
    while at < start + size:
        data = source.read(at, min(PIECE, start + size - at))
        if not data:
            raise Failed("record end")
        block.update(data)
        at += len(data)
        if not inside:
            lead += data[: max(0, HEADER - len(lead))]
            joined = last + data
            split = joined.find(b"\r\n\r\n")
            if split < 0:
                last = joined[-3:]
                continue
            inside, data = True, joined[split + 4 :]
        body.update(data)
        length += len(data)
        if keep:
            held.append(data)
    declared = headers.get("warc-block-digest", "")
    if declared.startswith("sha1:") and declared[5:] != base32(block):
        raise Failed("block digest")
    declared = headers.get("warc-payload-digest", "")
    if declared.startswith("sha1:") and headers["warc-type"] in ("response", "resource") and declared[5:] != base32(body):
        raise Failed("payload digest")
    return Record(headers, end, length, base32(body), lead, b"".join(held) if keep else None)


def parse(source, at: int, keep: bool = False) -> Record:
    """The record at a place of a window, of inflated or of held bytes. Its block is not read if it does not end as it should."""
    head = source.read(at, HEADER)
    if not re.match(rb"WARC/1\.\d\r\n", head):
        raise Failed("version line")
    while (split := head.find(b"\r\n\r\n")) < 0:
        if not all(re.match(rb"[^:]*[^:\s][^:]*:", line) for line in head.split(b"\r\n")[1:-1]):
            raise Failed("header line")
        more = source.read(at + len(head), len(head))
        if not more:
            raise Failed("header end")
        head += more
    headers = parse_header(head[:split])
    size, start = int(headers["content-length"]), at + split + 4
    if start + size + 4 > source.size:
        raise Failed("record end")
    if isinstance(source, Inflated):
        record = scan_block(source, headers, start, size, start + size + 4, keep)
        if source.read(start + size, 4) != b"\r\n\r\n":
            raise Failed("record end")
        return record
    if source.peek(start + size, 4) != b"\r\n\r\n":
        raise Failed("record end")
    return scan_block(source, headers, start, size, start + size + 4, keep)


def walk(source, doubtful: bool, keep: bool) -> Iterator[Record | str]:
    """The records of inflated bytes that pass, and what the gaps between them are.

    Of doubtful bytes only records with a block digest can pass.
    """
    at, gap, why = 0, None, ""
    while at < source.size:
        source.mark(at)
        try:
            record = parse(source, at, keep)
            if doubtful and not record.headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Failed("no digest in a damaged member")
        except Failed as failure:
            if gap is None:
                gap, why = at, str(failure)
            at = source.find(at + 1)
            continue
        if gap is not None:
            yield f"{why}, bytes {gap} to {at} of the member"
            gap = None
        yield record
        at = record.end
    if gap is not None:
        yield f"{why}, bytes {gap} to {source.size} of the member"


class Found(NamedTuple):
    items: Callable[[], Iterator[Record | str]]  # records, and reasons of gaps inside a member
    end: int  # of the member or record; of the last record that passed, if the member fails
    failure: str | None


def records_at(window: Window, at: int, keep: bool) -> Found:
    """The records of the member or plain record at a place. It fails if it has bytes and no record in them passes.

    A member of up to ``SMALL`` bytes is inflated once; of a larger one first its end is found, then its records are read
    from it, each time they are asked for.
    """
    if window.read(at, 3) != MEMBER:
        record = parse(window, at, keep)
        return Found(lambda: iter([record]), record.end, None)
    inflater, parts, size = Inflater(window, at), [], 0
    while more := inflater.more():
        size += len(more)
        if size <= SMALL:
            parts.append(more)
    failure, end = inflater.failure, inflater.place
    doubtful = failure == "member checksum or data"
    if size <= SMALL:
        listed = list(walk(Held(b"".join(parts)), doubtful, keep))

        def items() -> Iterator[Record | str]:
            return iter(listed)
    else:
        parts.clear()

        def items() -> Iterator[Record | str]:
            return walk(Inflated(window, at, size), doubtful, keep)

    seen = sound = None
    for item in items():
        if isinstance(item, Record):
            sound = item.end
            if not failure:
                break
        else:
            seen = item
    if sound is None and (failure or seen):
        raise Failed(failure or f"no record in member: {seen.split(', bytes')[0]}")
    if failure:
        end = place_of(window, at, sound)
    return Found(items, end, failure)


def place_of(window: Window, at: int, size: int) -> int:
    """The place in the file that a member's first ``size`` bytes come from, up to its end."""
    inflater, made = Inflater(window, at), 0
    while made < size and (more := inflater.more(min(PIECE, size - made))):
        made += len(more)
    return inflater.place


def salvage(window: Window, keep: bool = False) -> Iterator[tuple[str, int, int, str | None, Record | None]]:
    """``kind, offset, length, reason, record`` of a file, without holes: each byte belongs to a record or a gap.

    The records of a member and the gaps between them have the place of the member. A member that fails is a gap up
    to the next place that passes; the records in it that pass have that place too.
    """
    at, gap, why, held = 0, None, None, None

    def rows(offset: int, end: int, found: Found) -> Iterator[tuple[str, int, int, str | None, Record | None]]:
        for item in found.items():
            if isinstance(item, Record):
                yield "record", offset, end - offset, None, item
            else:
                yield "gap", offset, end - offset, item, None

    while at < window.size:
        try:
            found = records_at(window, at, keep)
        except Failed as failure:
            if gap is None:
                gap, why = at, str(failure)
            at = window.find(at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why, None
            if held is not None:
                yield from rows(gap, at, held)
            gap = held = None
        if found.failure:
            gap, why, held = at, found.failure, found
            at = window.find(max(found.end, at + 1))
            continue
        yield from rows(at, found.end, found)
        at = found.end
    if gap is not None:
        yield "gap", gap, window.size - gap, why, None
        if held is not None:
            yield from rows(gap, window.size, held)


def found_row(path: str, kind: str, offset: int, length: int, reason: str | None, record: Record | None) -> tuple:
    if record is None:
        return kind, path, offset, length, reason, *[None] * 7
    headers, size = record.headers, record.size
    revisit = headers["warc-type"] == "revisit"
    if revisit and (told := re.search(rb"(?im)^content-length:\s*(\d+)", record.lead)):
        size = int(told[1])
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or record.digest
    return (
        kind, path, offset, length, reason, headers["warc-type"], headers.get("warc-record-id"), headers.get("warc-target-uri"),
        headers.get("warc-refers-to"), digest, size, None if revisit else record.payload,
    )


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps of the files in ``paths(path)``, one file to a task. Gaps have ``kind = 'gap'`` and a ``reason``.

    A task holds a few pieces of its file, whatever the size of files, members and records, besides ``payloads`` if they are asked for.
    """
    names = [c.split()[0] for c in FOUND.split(",")]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, inside = open_store(path)
                with store.open_input_file(inside) as file:
                    rows, held = [], 0
                    for found in salvage(Window(file, file.size()), payloads):
                        rows.append(found_row(path, *found))
                        held += len(rows[-1][-1] or b"") + 500
                        if held >= 8 * PIECE:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    each = paths.select("path")
    return each.repartition(max(each.count(), 1)).mapInPandas(over, FOUND)


def page_of(record_id: str):
    return F.expr("nullif(regexp_extract(%s, '^<urn:page:(-?[0-9]+)>$', 1), '')" % record_id).cast("long")


def op1_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages, read the archives back, and give each page's record."""
    manifest = write_archives(table(spark, folder, "pages"), scratch_path(spark, "warc"))
    found = read_archives(manifest, payloads=False).where("kind = 'record'")
    return found.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to")
    )



OP1_SQL = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
