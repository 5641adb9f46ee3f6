"""Removal of long passages that an earlier document has, by run-length indexes.

Every byte goes that some ``LENGTH``-byte string covers which also starts in a
document with a smaller id.

An index over a whole corpus fits no task, so texts meet in it only where they
can match.  Each window of ``LENGTH`` bytes has an anchor, the ``GRAM`` bytes in
it with the smallest hash; equal windows have equal anchors, and consecutive
windows mostly share one.  The windows of one anchor are its context.

1. Documents are packed into blocks (written, compressed); blocks are what the
   later steps read again, keyed by block.
2. Every context travels as two 48-bit hashes (anchor, context); copies inside
   a block are settled there.  Where anchors meet, contexts that are equal to
   one of an earlier document are removed as a whole.
3. An anchor alone meets by chance, the more often the larger the corpus.  A
   window reaches ``SIDE`` bytes past its anchor to the left or to the right, so
   of contexts that share an anchor only those can have a window in common that
   also share the bytes of one of these sides (two 16-bit hashes).
   Only contexts that share a side with a *different* one (the edges of
   copied passages) are sent as bytes, those of ``TOGETHER`` indexes in one piece
   of each block.  For each of these parts a run-length index is built over the
   stretches whose windows have a hash that another document's window has too: suffix order, Burrows-Wheeler runs, and at each run head the
   sampled suffix, its predecessor and their common prefix.  Between samples the
   predecessor moves by one and the prefix shrinks by one, so the matching
   statistics of all positions stream from the r samples.  Positions whose match
   is long enough form classes; those with an earlier document in their class
   are marked.
4. The marks meet their blocks again.

An anchor with more than ``HOT`` different contexts (a phrase on the edge of a
passage in very many documents) is not indexed as one group: its windows are
sent one by one, grouped by their own hash, after equal ones of a block have
been merged.  A block in which an anchor has more than ``LOCAL_HOT`` contexts
does so at once, and sends only a mark that makes the other blocks do the same.
So where an anchor's contexts meet there are at most ``LOCAL_HOT`` of each block,
and where windows meet, one of each block.

Blocks and buckets grow with the corpus up to a fixed size, which keeps the
number of pieces (blocks times buckets) in proportion up to some terabytes.

Defined results: null counts as empty and texts shorter than ``LENGTH`` bytes
stay; a null id matches nothing; rows of one id do not match each other;
repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage
from .textvec import CHUNK, U, mix, powers, prefix_sums, span_hash, string_bytes

LENGTH, GRAM = 50, 20
SIDE = (LENGTH - GRAM) // 2
#: Least and most bytes of a block, and documents for each of the least bytes.
BLOCK, MOST_BLOCK = 4 << 20, 64 << 20
BLOCK_DOCS = 60_000
#: Raw bytes of text for each bucket of context hashes (least and most), and of contexts for each index.
BUCKET_TEXT, MOST_BUCKET_TEXT, BUCKET_INDEX = 24 << 20, 256 << 20, 2 << 20
#: Indexes whose contexts travel together, and are built one after the other.
TOGETHER = 16
HOT, LOCAL_HOT = 16384, 1024
PLACE = U((1 << 24) - 1)
BLOCKS = "block long, ids array<long>, lens array<long>, data binary"


def pack(docs: DataFrame, block: int) -> DataFrame:
    """block, ids, lens, data: documents by id in blocks of about ``block`` bytes."""
    most = max(1, BLOCK_DOCS * block // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size, number
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
            out = [[number], [[r[0] for r in rows]], [[len(r[1]) for r in rows]], [squeeze.compress(b"".join(r[1] for r in rows))]]
            rows, size, number = [], 0, number + 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["block", "ids", "lens", "data"])

        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            o = offsets.tolist()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                rows.append((doc_id, data[o[i] : o[i + 1]].tobytes()))
                size += o[i + 1] - o[i]
                if size >= block or len(rows) >= most:
                    yield flush()
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def _unpacked(ids: list, lens: list, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids and which ids are null."""
    offsets = np.concatenate([[0], np.cumsum(np.array(lens, np.int64))])
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(offsets[-1]) or 1) if offsets[-1] else b""
    return np.frombuffer(raw, np.uint8), offsets, np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], bool)


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK bytes: whole documents, or overlapping parts of a long one."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        a, b = int(offsets[at]), int(offsets[min(end, n)])
        while b - a > 4 * CHUNK:
            yield a, a + CHUNK + LENGTH - 1
            a += CHUNK
        yield a, b
        at = end


def contexts(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor hash, context hash, document, first window, last window, left side, right side (0: no window reaches it) of every context."""
    out = []
    for a, b in _pieces(offsets):
        part = data[a:b]
        m = len(part) - LENGTH + 1
        if m <= 0:
            continue
        sums = prefix_sums(part)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[GRAM - 1 : len(sums) - 1])
        v = (grams & ~PLACE) | np.arange(len(grams), dtype=U)
        width, covered = LENGTH - GRAM + 1, 1
        while 2 * covered <= width:
            v = np.minimum(v[:-covered], v[covered:])
            covered *= 2
        if covered < width:
            v = np.minimum(v[: m], v[width - covered : width - covered + m])
        doc = np.searchsorted(offsets, np.arange(a, a + m), "right") - 1
        starts = np.flatnonzero((np.arange(a, a + m) + LENGTH <= offsets[doc + 1]) & ~skip[doc])
        if not len(starts):
            continue
        place = (v[starts] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        first, last, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], place[new]
        c = mix(span_hash(sums, first, last + LENGTH) + (at - first).astype(U) * U(0x9E3779B97F4A7C15))
        wide = [np.flatnonzero(at - first >= SIDE), np.flatnonzero(last + LENGTH - at - GRAM >= SIDE)]
        sides = [np.zeros(len(at), "<u2"), np.zeros(len(at), "<u2")]
        for side, x, back in zip(sides, wide, (SIDE, 0)):
            begin = at[x] - back
            side[x] = span_hash(sums, begin, begin + SIDE + GRAM) % U(65535) + U(1)
        out.append((grams[at], c, doc[first], first + a, last + a, *sides))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(U), z.astype(U), z, z, z, z.astype("<u2"), z.astype("<u2")
    return tuple(np.concatenate(x) for x in zip(*out))


def _first_of(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row the least ``order`` among rows of the same key."""
    by = np.lexsort((order, key))
    k = key[by]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    out = np.empty(len(key), order.dtype)
    out[by] = order[by][np.flatnonzero(head)][np.cumsum(head) - 1]
    return out


def _by_block(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each block's number and the rows that have it, in their order; time does not grow with the blocks."""
    if not len(number):
        return iter(())
    by = np.argsort(number, kind="stable")
    found, at = np.unique(number[by], return_index=True)
    return zip(found.tolist(), np.split(by, at[1:]))


def _six(x: np.ndarray) -> bytes:
    """The lower 48 bits of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(n, 6)
    return out.view("<u8").reshape(n)


def _blob(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _unblob(b: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


SENT = ["<i8", "<i4", "<u1"]  # document id (differences), first window (differences), windows
REPLY = ["<i4", "<u1", "<u1"]  # first window, windows, kind
WHOLE, INDEX, SINGLE = 0, 1, 2


def anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, hashes, rest, sides, hot: the contexts of each block by bucket, and the anchors that are hot in it; what needs no other block has no hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, lens, packed in zip(*(c.to_pylist() for c in batch.columns)):
                data, offsets, doc_ids, null = _unpacked(ids, lens, packed)
                h, c, doc, first, last, left, right = contexts(data, offsets, null)
                if not len(h):
                    continue
                owner = doc_ids[doc]
                least = _first_of(mix(h) + c, owner)
                rows = []
                again, own = np.flatnonzero(owner > least), np.flatnonzero(owner == least)
                names, which, often = np.unique(h[own], return_inverse=True, return_counts=True)
                hot = names[often > LOCAL_HOT]
                single, own = own[often[which] > LOCAL_HOT], own[often[which] <= LOCAL_HOT]
                for x, kind in ((again, WHOLE), (single, SINGLE)):
                    if len(x):
                        rows.append((number % buckets, number, None, _blob([first[x].astype("<i4"), (last - first)[x].astype("<u1"), np.full(len(x), kind, "<u1")]), None, None))
                bucket = ((h[own] >> U(24)) % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, at = np.unique(bucket[order], return_index=True)
                for b, x in zip(found.tolist(), np.split(own[order], at[1:])):
                    rest = _blob([np.diff(owner[x], prepend=0).astype("<i8"), np.diff(first[x], prepend=0).astype("<i4"), (last - first)[x].astype("<u1")])
                    rows.append((b, number, _six(h[x] >> U(16)) + _six(c[x] >> U(16)), rest, left[x].tobytes() + right[x].tobytes(), None))
                for x in hot.tolist():
                    rows.append(((x >> 24) % buckets, number, None, None, None, _six(np.array([x >> 16], U))))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["bucket", "block", "hashes", "rest", "sides", "hot"])

    return blocks.mapInArrow(run, "bucket long, block long, hashes binary, rest binary, sides binary, hot binary")


def _shared(group: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which of these different contexts share a side with another of their group (an anchor); without sides, all."""
    if not len(sides):
        return np.ones(len(group), bool)
    out = np.zeros(len(group), bool)
    for side in sides:
        at = np.flatnonzero(side)
        key = group[at].astype(np.int64) << 16 | side[at]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        out[at[by[1:][same]]] = out[at[by[:-1][same]]] = True
    return out


def _settle(t: pa.Table) -> pa.Table:
    """For one bucket: which contexts go as a whole, and which must be compared as bytes."""
    blocks, out = [], []
    hs, cs, owners, firsts, ns, of, sides = [], [], [], [], [], [], []
    known = t.column("sides").to_pylist() if "sides" in t.column_names else [None] * t.num_rows
    for number, hashes, rest, side in zip(t.column("block").to_pylist(), t.column("hashes").to_pylist(), t.column("rest").to_pylist(), known):
        if hashes is None:
            if rest is not None:
                blocks.append(number)
                out.append(rest)
            continue
        owner, first, n = _unblob(rest, SENT)
        k = len(owner)
        hs.append(_from_six(hashes[: 6 * k], k))
        cs.append(_from_six(hashes[6 * k :], k))
        owners.append(np.cumsum(owner))
        firsts.append(np.cumsum(first.astype(np.int64)))
        ns.append(n)
        of.append(np.full(k, number))
        if side is not None:
            sides.append(np.frombuffer(side, "<u2").reshape(2, k))
    if hs:
        h, c, owner, first, n, number = (np.concatenate(x) for x in (hs, cs, owners, firsts, ns, of))
        sides = np.concatenate(sides, axis=1) if sides else np.zeros((0, len(h)), "<u2")
        by = np.argsort(h, kind="stable")
        s = h[by]
        head = np.concatenate([[True], s[1:] != s[:-1]])
        size = np.diff(np.append(np.flatnonzero(head), len(s)))
        marks = b"".join(x for x in t.column("hot").to_pylist() if x is not None)
        is_hot = np.isin(s[head], _from_six(marks, len(marks) // 6))
        by = by[np.repeat((size > 1) | is_hot, size)]  # an anchor that occurs once matches nothing
        hot = s[head][is_hot]
        h, c, owner, first, n, number, sides = (x[..., by] for x in (h, c, owner, first, n, number, sides))
        by = np.lexsort((owner, c, h))
        h, c, owner, first, n, number, sides = (x[..., by] for x in (h, c, owner, first, n, number, sides))
        if len(h):
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            group_h, group_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
            least = owner[np.flatnonzero(new_c)][group_c]
            one = np.flatnonzero(new_c)  # of each of the different contexts
            shared = _shared(group_h[one], sides[:, one])
            texts = np.bincount(group_h[one], weights=shared, minlength=group_h[-1] + 1)[group_h]
            left = np.where(shared[group_c] & (texts > 1), np.where(texts > HOT, SINGLE, INDEX), 9)
            kind = np.where(owner > least, WHOLE, np.where(np.isin(h, hot), SINGLE, left)).astype("<u1")
            needed = np.flatnonzero(kind != 9)
            for b, x in _by_block(number[needed]):
                x = needed[x]
                blocks.append(b)
                out.append(_blob([first[x].astype("<i4"), n[x], kind[x]]))
    return pa.table({"block": pa.array(blocks, pa.int64()), "reply": pa.array(out, pa.binary())})


def _sent(indexes: int):
    """Contexts of a block that its replies ask for, by index of their anchor (or of their window), so many indexes to a bucket."""

    def run(t: pa.Table) -> pa.Table:
        number = t.column("block")[0].as_py()
        replies = [r for r in t.column("reply").to_pylist() if r is not None]
        at = [i for i, d in enumerate(t.column("data").to_pylist()) if d is not None]
        if replies and at:
            data, offsets, doc_ids, _ = _unpacked(*(t.column(c)[at[0]].as_py() for c in ("ids", "lens", "data")))
            first, n, kind = (np.concatenate(x) for x in zip(*(_unblob(r, REPLY) for r in replies)))
            first = first.astype(np.int64)
            whole = np.flatnonzero(kind == INDEX)
            single = np.flatnonzero(kind == SINGLE)
            start, last = first[whole], (first + n)[whole]
            if len(single):
                counts = n[single].astype(np.int64) + 1
                windows = np.repeat(first[single] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                start, last = np.concatenate([start, windows]), np.concatenate([last, windows])
            if len(start):
                sums = prefix_sums(data)
                key = _anchor_of(data, sums, start, last)
                key[len(whole) :] = span_hash(sums, start, start + LENGTH)[len(whole) :]
                owner = doc_ids[np.searchsorted(offsets, start, "right") - 1]
                alone = np.arange(len(start)) >= len(whole)
                # Of equal windows in this block only those of the first document need be compared.
                keep = ~alone | (owner == _first_of(np.where(alone, key, mix(key ^ start.astype(U))), owner))
                copy = np.flatnonzero(~keep)
                index = ((mix(key) >> U(8)) % U(indexes)).astype(np.int64)
                kept = np.flatnonzero(keep)
                kept = kept[np.argsort(index[kept], kind="stable")]
                bucket, part = index // TOGETHER, (index % TOGETHER).astype("<u1")
                found, at = np.unique(bucket[kept], return_index=True)
                rows = zip(found.tolist(), np.split(kept, at[1:])) if len(kept) else []
                out = []
                for b, x in rows:
                    text = b"".join(data[s : e + LENGTH].tobytes() + b"\xff" for s, e in zip(start[x].tolist(), last[x].tolist()))
                    out.append((b, number, _blob([owner[x].astype("<i8"), start[x].astype("<i4"), part[x]]), zstandard.ZstdCompressor(level=1).compress(text)))
                if len(copy):
                    out.append((0, number, _blob([start[copy].astype("<i4"), np.zeros(len(copy), "<u1"), np.zeros(len(copy), "<u1")]), None))
                return pa.table({k: pa.array(v, kind) for (k, kind), v in zip((("bucket", pa.int64()), ("block", pa.int64()), ("owners", pa.binary()), ("texts", pa.binary())), zip(*out))})
        return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "owners": pa.array([], pa.binary()), "texts": pa.array([], pa.binary())})

    return run


def _anchor_of(data: np.ndarray, sums: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of the anchor that the windows start..last share."""
    p = powers(len(sums))
    best = np.full(len(start), np.iinfo(np.uint64).max, U)
    out = np.zeros(len(start), U)
    # The anchor lies in all of the windows, so in the last one it is the least among the grams of the first too.
    for k in range(LENGTH - GRAM + 1):
        at = np.minimum(last + k, start + LENGTH - GRAM)
        g = mix((sums[at + GRAM] - sums[at]) * p[at + GRAM - 1])
        less = (g & ~PLACE) < best
        best = np.where(less, g & ~PLACE, best)
        out = np.where(less, g, out)
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts that end in 0xFF each.

    Of the suffix order only the samples at run heads are kept: text position,
    the position before it in the order, and the length of their common prefix.
    """

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        end = text == 255
        symbol = np.where(end, 0, text.astype(np.int64) + 1).astype(U)
        stop = np.flatnonzero(end)[np.searchsorted(np.flatnonzero(end), np.arange(n))]  # its terminator
        key = np.zeros(n, U)
        for k in range(7):
            at = np.arange(n) + k
            key = (key << U(9)) | np.where(at < stop, symbol[np.minimum(at, n - 1)], U(0))
        order = np.argsort(key, kind="stable")  # suffixes with a terminator this near stay in the order of terminators
        k, ended = key[order], (stop - np.arange(n) < 7)[order]
        new, depth = np.concatenate([[True], (k[1:] != k[:-1]) | ended[1:]]), 7
        rank, at, left = np.empty(n, np.int64), np.arange(n), order
        while True:  # a rank is the place of the first of its equals; only what has equals is sorted on
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(new)))
            rank[left] = np.repeat(at[heads], size)
            open_ = np.repeat(size > 1, size)
            if not open_.any():
                break
            at, left = at[open_], left[open_]
            after = left + depth
            key = rank[left].astype(U) * U(n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0).astype(U)
            by = np.argsort(key)
            left, key = left[by], key[by]
            order[at] = left
            new = np.concatenate([[True], key[1:] != key[:-1]])
            depth *= 2
        bwt = np.where(order > 0, text[order - 1], 255)
        heads = np.flatnonzero(np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 255)]))
        self.runs = len(heads)
        sample, before = order[heads], np.where(heads > 0, order[heads - 1], -1)
        by = np.argsort(sample)
        self.sample, self.before = sample[by], before[by]
        self.common = self._common(text, stop, self.sample, self.before)

    @staticmethod
    def _common(text: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.where(b < 0, 0, np.minimum(stop[a] - a, stop[b] - b))
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(live):
            same = text[a[live] + out[live]] == text[b[live] + out[live]]
            live = live[same]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position the one before it in suffix order, and their common prefix."""
        at = np.searchsorted(self.sample, np.arange(self.n), "right") - 1
        moved = np.arange(self.n) - self.sample[at]
        return self.before[at] + moved, np.maximum(self.common[at] - moved, 0)


def marked(text: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions whose LENGTH bytes a text of a smaller owner has too.  owner: of each position."""
    before, common = RunLengthIndex(text).matching()
    root = np.where(common >= LENGTH, before, np.arange(len(text)))
    linked = np.flatnonzero(common >= LENGTH)
    while True:  # to the first of its class
        up = root[root[linked]]
        if np.array_equal(up, root[linked]):
            break
        root[linked] = up
    least = owner.copy()
    np.minimum.at(least, root[linked], owner[linked])
    members = np.unique(np.concatenate([linked, root[linked]]))
    return members[owner[members] > least[root[members]]]


def stretches(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts (each ends in 0xFF) number, begin and end of what an index has to compare: windows that by their hashes another owner has too."""
    n = np.maximum(ends - begins - LENGTH, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(len(row))
    h = span_hash(prefix_sums(text), at, at + LENGTH)
    by = np.argsort(h)
    head = np.flatnonzero(np.concatenate([[True], h[by[1:]] != h[by[:-1]]])) if len(h) else np.zeros(0, np.int64)
    o = owner[row[by]]
    mixed = np.minimum.reduceat(o, head) != np.maximum.reduceat(o, head) if len(h) else np.zeros(0, bool)
    x = np.sort(by[np.repeat(mixed, np.diff(np.append(head, len(h))))])
    new = np.concatenate([[True], (np.diff(x) != 1) | (np.diff(row[x]) != 0)]) if len(x) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1 if len(x) else first
    return row[x[first]], at[x[first]], at[x[last]] + LENGTH


def _index(t: pa.Table) -> pa.Table:
    """For the contexts of one bucket, index by index: marks of single windows, by block."""
    blocks, out, texts, owners, places, parts, blocked = [], [], [], [], [], [], []
    for number, o, z in zip(t.column("block").to_pylist(), t.column("owners").to_pylist(), t.column("texts").to_pylist()):
        if z is None:
            blocks.append(number)
            out.append(o)
            continue
        owner, start, part = _unblob(o, ["<i8", "<i4", "<u1"])
        texts.append(zstandard.ZstdDecompressor().decompress(z))
        owners.append(owner)
        places.append(start.astype(np.int64))
        parts.append(part)
        blocked.append(np.full(len(owner), number))
    if texts:
        every = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        owner, place, part, number = (np.concatenate(x) for x in (owners, places, parts, blocked))
        ends = np.flatnonzero(every == 255) + 1
        begins = np.concatenate([[0], ends[:-1]])
        numbers, starts = [], []
        for _, own in _by_block(part):
            sizes = ends[own] - begins[own]
            at = np.cumsum(sizes) - sizes  # of each context in the text of its index
            text = every[np.repeat(begins[own] - at, sizes) + np.arange(sizes.sum())]
            of, a, b = stretches(text, at, at + sizes, owner[own])
            if not len(of):
                continue
            sizes = b - a + 1
            to = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(of)), sizes)
            text = text[np.minimum(np.repeat(a - to, sizes) + np.arange(len(row)), len(text) - 1)]
            text[to + sizes - 1] = 255
            hit = marked(text, owner[own[of]][row])
            r = row[hit]
            numbers.append(number[own[of[r]]])
            starts.append(place[own[of[r]]] + a[r] - at[of[r]] + hit - to[r])
        start = np.concatenate([np.zeros(0, np.int64), *starts])
        for b, x in _by_block(np.concatenate([np.zeros(0, np.int64), *numbers])):
            blocks.append(b)
            out.append(_blob([start[x].astype("<i4"), np.zeros(len(x), "<u1"), np.zeros(len(x), "<u1")]))
    return pa.table({"block": pa.array(blocks, pa.int64()), "reply": pa.array(out, pa.binary())})


def _final(t: pa.Table) -> pa.Table:
    """One row for each document of a block, without its marked bytes."""
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    at = [i for i, d in enumerate(t.column("data").to_pylist()) if d is not None]
    ids = t.column("ids")[at[0]].as_py()
    data, offsets, _, _ = _unpacked(ids, t.column("lens")[at[0]].as_py(), t.column("data")[at[0]].as_py())
    delta = np.zeros(len(data) + 1, np.int64)
    for r in t.column("reply").to_pylist():
        if r is not None:
            first, n, kind = _unblob(r, REPLY)
            first, n = first[kind == WHOLE].astype(np.int64), n[kind == WHOLE].astype(np.int64)
            np.add.at(delta, first, 1)
            np.add.at(delta, first + n + LENGTH, -1)
    gone = np.cumsum(delta[:-1]) > 0
    rows = []
    for i, doc_id in enumerate(ids):
        a, b = int(offsets[i]), int(offsets[i + 1])
        g = gone[a:b]
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        rows.append((doc_id, b - a, int(g.sum()), spans, data[a:b][~g].tobytes()))
    return pa.table({k: pa.array(v, kind) for (k, kind), v in zip(names.items(), zip(*rows))})


def _with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    nothing = lambda kind: F.lit(None).cast(kind)
    a = blocks.select("block", "ids", "lens", "data", nothing("binary").alias("reply"))
    b = replies.select("block", nothing("array<long>").alias("ids"), nothing("array<long>").alias("lens"), nothing("binary").alias("data"), "reply")
    return a.union(b)


def without_earlier(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes, or their SHA-256)."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = stage(pack(docs, min(MOST_BLOCK, max(BLOCK, total >> 16))), "blocks")
    buckets = 1 + total // min(MOST_BUCKET_TEXT, max(BUCKET_TEXT, total >> 14))
    settled = anchors(blocks, buckets).groupBy("bucket").applyInArrow(_settle, "block long, reply binary")
    replies = stage(settled, "replies")
    size = replies.agg(F.sum(F.length("reply"))).first()[0] or 0
    indexes = 1 + 12 * size // BUCKET_INDEX
    sent = _with_replies(blocks, replies).groupBy("block").applyInArrow(_sent(indexes), "bucket long, block long, owners binary, texts binary")
    marks = stage(sent.groupBy("bucket").applyInArrow(_index, "block long, reply binary"), "marks")

    def final(t: pa.Table) -> pa.Table:
        out = _final(t)
        if digest:
            hexes = [hashlib.sha256(x).hexdigest() for x in out.column("kept").to_pylist()]
            out = out.set_column(4, "kept", pa.array(hexes, pa.string()))
        return out

    kind = "string" if digest else "binary"
    return _with_replies(blocks, replies.union(marks)).groupBy("block").applyInArrow(final, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(generate_series(0, n - 50)) AS g(i)),
f AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.f < w.doc_id),
isle AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM
    (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM hit)) GROUP BY doc_id, k),
seg AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p, a AS q FROM isle UNION ALL SELECT d.doc_id, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN isle USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS k FROM d JOIN seg USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans FROM isle GROUP BY doc_id) r USING (doc_id)
"""
