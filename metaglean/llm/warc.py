"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: records of equal payloads (by SHA-256, of at least ``MIN_REVISIT``
bytes) become one response, that of the smallest id, and revisits without a
block.  Each task writes one archive under a name of its own attempt; only the
names that successful tasks return are read again, so a repeated task can leave
nothing but an unread file.

Reading: archives are cut into ranges of ``RANGE`` bytes.  The task of a range
looks for the record magic in it, and takes each as a *candidate* record with
the successor that its Content-Length claims; payloads may hold the magic too,
so candidates prove nothing.  Inside its range a task follows candidates to the
first offset beyond it (the exit).  Pointer jumping over these entry-to-exit
links, from offset 0 of every file, keeps the reachable entries in a number of
rounds that is logarithmic in the ranges of the longest file.  A second pass
over the ranges yields the records of the chains that start at reachable
entries; a magic inside a payload is on no such chain.  Headers may have any
size; an entry whose chain breaks inside its range has no exit, and its records
before the break are yielded.

Defined results: null payload counts as empty; rows of one id each have a
record; ties on equal payloads go to the smallest id; an empty table gives no
records; where a chain breaks (a header is damaged or a record is cut off), the
records after it in that file can't be proven.  ``strict`` reading raises then
and names such archives; else the records before the break are returned.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_at_exit, shared_dir, ship, stage

MIN_REVISIT = 100
RANGE = 8 << 20
MAGIC = b"WARC/1.0\r\n"
PIECE = 4 << 10
#: Copied digests (some 140 bytes each) that are sent to every task.
BROADCAST_DIGESTS = 100_000
#: Tasks that read, at most; up to that, one for each range.
TASKS = 100_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has no block, its headers name length and digest."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one archive a task into ``folder``; returns number, path and bytes of each."""
    ship(df.sparkSession)
    p = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stage(first, "first")
    # Payloads move only if the copied digests are too many to send to every task.
    rows = p.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc"
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, payload, digest, head = (batch.column(k)[i].as_py() for k in range(5))
                    if out is None:
                        fs, at = _open(path)
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(at)
                    again = head is not None and page_id != head
                    data = record("revisit" if again else "response", page_id, url, payload, digest, head if again else None)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([path]), pa.array([size], pa.int64())], ["file", "path", "bytes"])

    return rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "file long, path string, bytes long")


class Range:
    """The bytes of an archive from ``start``, with more read as needed."""

    def __init__(self, path: str, start: int, end: int, total: int):
        fs, at = _open(path)
        self.start, self.end, self.total, self.path = start, end, total, path
        self.file = fs.open_input_file(at)
        self.data = self.read(start, min(total, end + len(MAGIC)) - start)
        self.scanned: dict[int, tuple[int, bytes | None] | None] = {}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def find(self, what: bytes, at: int, end: int | None = None) -> int:
        """Offset of the first ``what`` from ``at`` to ``end`` (of the file), or -1; reads on in growing pieces."""
        end = self.total if end is None else end
        i = self.data.find(what, at - self.start, end - self.start)
        if i >= 0:
            return self.start + i
        at, n = max(at, self.start + len(self.data) - len(what) + 1), PIECE
        while at + len(what) <= end:
            piece = self.read(at, min(n, end - at))
            i = piece.find(what)
            if i >= 0:
                return at + i
            if len(piece) < len(what):
                break
            at, n = at + len(piece) - len(what) + 1, min(2 * n, 1 << 20)
        return -1

    def scan(self, at: int) -> tuple[int, bytes | None] | None:
        """The block's offset and the Content-Length of the record at ``at``, if headers are there.

        Lines behind the first one of an earlier call are not read again, so the
        candidates of a range, from the last to the first, take one pass.
        """
        if self.block(at, len(MAGIC)) != MAGIC:
            return None
        first = p = at + len(MAGIC)
        found, length = None, None
        while p not in self.scanned:
            stop = self.find(b"\r\n", p)
            if stop == p:
                found = p + 2, None
            colon = self.find(b":", p, stop) if stop > p else -1
            if colon < 0:
                break
            if self.block(p, colon - p).strip().lower() == b"content-length":
                length = self.block(colon + 1, stop - colon - 1).strip()
            p = stop + 2
        else:
            found = self.scanned[p]
        if found is not None and found[1] is None:
            found = found[0], length
        self.scanned[first] = found
        return found

    def head(self, at: int) -> tuple[dict[bytes, bytes], int] | None:
        """Headers and the block's offset of the record at ``at``, if one is there."""
        found = self.scan(at)
        if found is None:
            return None
        head = {}
        for line in self.block(at + len(MAGIC), found[0] - 4 - at - len(MAGIC)).split(b"\r\n"):
            key, _, value = line.partition(b":")
            head[key.strip().lower()] = value.strip()
        return head, found[0]

    def successor(self, at: int) -> int | None:
        """Where the record at ``at`` says that the next one starts."""
        found = self.scan(at)
        if not found or not (found[1] or b"").isdigit():
            return None
        after = found[0] + int(found[1]) + 4
        return after if after <= self.total else None

    def candidates(self) -> list[int]:
        out, i, stop = [], self.data.find(MAGIC), self.end - self.start
        while 0 <= i < stop:
            out.append(self.start + i)
            i = self.data.find(MAGIC, i + 1)
        return out

    def block(self, at: int, n: int) -> bytes:
        i = at - self.start
        return self.data[i : i + n] if i + n <= len(self.data) else self.read(at, n)


def ranges(archives: DataFrame, size: int = RANGE) -> DataFrame:
    """file, path, bytes, start, end of the ranges of all archives."""
    d = archives.where("bytes > 0").select("file", "path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {size}L)")).alias("start"))
    return d.select("file", "path", "bytes", "start", F.least(F.col("start") + size, "bytes").alias("end"))


def spread(parts: DataFrame, n: int) -> DataFrame:
    """``n`` rows of ranges over tasks by what they read, not by how small the rows are."""
    return parts.repartition(max(1, min(n, TASKS)))


def links(parts: DataFrame) -> DataFrame:
    """file, entry, exit: of every candidate the first chained offset outside its range, null if the chain breaks in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, total, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                r = Range(path, start, end, total)
                leave: dict[int, int | None] = {}
                for at in reversed(r.candidates()):
                    after = r.successor(at)
                    if after is not None:
                        leave[at] = leave.get(after) if after < end else after
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(leave), pa.int64()), pa.array(list(leave), pa.int64()), pa.array(list(leave.values()), pa.int64())], ["file", "entry", "exit"])

    return parts.select("file", "path", "bytes", "start", "end").mapInArrow(run, "file long, entry long, exit long")


def reachable(edges: DataFrame) -> DataFrame:
    """file, entry: the entries that pointer jumping reaches from offset 0."""
    jump = edges
    seen = stage(edges.where("entry = 0").select("file", "entry"), "seen")
    n = seen.count()
    while True:
        step = seen.join(jump, ["file", "entry"]).select("file", F.col("exit").alias("entry"))
        wider = stage(seen.union(step.join(edges, ["file", "entry"], "left_semi")).distinct(), "seen")
        m = wider.count()
        if m == n:
            return wider
        seen, n = wider, m
        far = jump.select("file", F.col("entry").alias("exit"), F.col("exit").alias("beyond"))
        jump = stage(jump.join(far, ["file", "exit"]).select("file", "entry", F.col("beyond").alias("exit")), "jump")


def broken(archives: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """path of the archives whose chain of reachable entries doesn't end where the file does."""
    ends = entries.join(edges, ["file", "entry"]).select("file", F.col("exit").alias("bytes"))
    return archives.where("bytes > 0").join(ends, ["file", "bytes"], "left_anti").select("path")


def read(archives: DataFrame, size: int = RANGE, strict: bool = False) -> DataFrame:
    """page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    ``archives`` names the files: file (any number of its own), path, bytes.
    The payload of a revisit is null; its length and digest are those of its headers.
    """
    ship(archives.sparkSession)
    parts = stage(ranges(archives, size), "ranges")
    n = parts.count()
    edges = stage(links(spread(parts, n)), "links")
    seen = reachable(edges)
    if strict and (lost := broken(archives, seen, edges).take(9)):
        raise ValueError(f"records can't be proven to the end of {', '.join(r.path for r in lost)}")
    entries = seen.select("file", "entry", (F.floor(F.col("entry") / size) * size).alias("start"))
    # A range is entered once at most, by the one chain of its file.
    found = parts.join(entries.groupBy("file", "start").agg(F.min("entry").alias("entry")), ["file", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, start, end, at in zip(*(c.to_pylist() for c in batch.columns)):
                r, rows, held = Range(path, start, end, total), [], 0
                while at < end and (after := r.successor(at)) is not None:
                    head, block = r.head(at)
                    kind, n = head[b"warc-type"].decode(), int(head[b"content-length"])
                    payload = r.block(block, n) if kind == "response" else None
                    if payload is not None and len(payload) != n:
                        raise ValueError(f"record at {at} of {path} is cut off")
                    name = lambda v: int(v[len(b"<urn:page:") : -1]) if v and v[len(b"<urn:page:") : -1] else None
                    length = int(head[b"x-payload-length"]) if payload is None else n
                    digest = head[b"warc-payload-digest"].decode().partition(":")[2] if payload is None else hashlib.sha256(payload).hexdigest()
                    url = head.get(b"warc-target-uri")
                    rows.append((name(head[b"warc-record-id"]), None if url is None else url.decode(), kind, payload, length, digest, name(head.get(b"warc-refers-to"))))
                    held += n
                    at = after
                    if held > RANGE:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return spread(found.select("path", "bytes", "start", "end", "entry"), n).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def round_trip(df: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back, every record or none."""
    folder = f"{shared_dir(df.sparkSession)}-archives"
    archives = stage(write(df, folder), "archives")
    forget_at_exit(df.sparkSession, folder)
    return read(archives, strict=True)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to FROM r
"""
