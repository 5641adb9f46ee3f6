"""Byte-level BPE encoding and decoding.

Encoding follows the merge order with a priority queue of (rank, position) over
a doubly linked list of symbols.  A popped entry whose symbols have changed
since it was pushed is stale and skipped, so a word of n bytes costs
O(n log n) even if it is the whole text.  Decoding concatenates vocabulary
strings.  Words repeat, so a worker keeps the ids of those it has seen; a full
store (``CACHE_WORDS``) is emptied, which changes no result.

Defined results: null text counts as empty; empty text has no ids and decodes
to the empty string; texts are never cut; equal rows give equal results; extra
columns of the input stay untouched, and result columns win a clash of names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import fresh_name, ship

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000
SPACES = regex.compile(r" (?=\s|$)").search
LAST_SPACE = regex.compile(r".(?:(?! (?=\S)).)*", regex.S).findall


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder of one byte-level BPE vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"])]
        self.ranks = {a << 20 | b: rank for rank, (a, b, _) in enumerate(self.rules)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for text, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in text) if all(c in value for c in text) else text.encode()
        for text, i in added.items():
            self.strings[i] = text.encode()
        self.added = {text: int(i).to_bytes(4, "little") for text, i in added.items()}
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.cache: dict[str, bytes] = {}  # by what follows a space
        self.known: dict[str, bytes] = {}  # by word
        self.words = regex.compile(WORDS).findall

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids, n, ranks = [self.first[b] for b in word], len(word), self.ranks
        if n < 2:
            return ids
        before, after, shift = list(range(-1, n - 1)), list(range(1, n + 1)), n.bit_length()
        queue = [r << shift | i for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        mask, pop, push, rules = (1 << shift) - 1, heapq.heappop, heapq.heappush, self.rules
        while queue:
            i = pop(queue)
            left, right, new = rules[i >> shift]
            i &= mask
            if ids[i] != left or (j := after[i]) >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(new << 20 | ids[k])) is not None:
                    push(queue, r << shift | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(ids[h] << 20 | new)) is not None:
                push(queue, r << shift | h)
        return [x for x in ids if x >= 0]

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.special and any(t in text for t in self.added):
            return b"".join([self.added[p] if p in self.added else self.packed_plain(p) for p in self.special.split(text)])
        return self.packed_plain(text)

    def packed_plain(self, text: str) -> bytes:
        """A space before anything but white space always starts a word, so the
        pieces between such spaces are encoded, and kept, one by one."""
        if SPACES(text):
            return b"".join([self.piece(p) for p in LAST_SPACE(text)])
        first, *rest = text.split(" ")
        cache = self.cache
        try:
            return self.piece(first) + b"".join([cache[p] for p in rest])
        except KeyError:
            return self.piece(first) + b"".join([cache[p] if p in cache else self.keep(p) for p in rest])

    def keep(self, rest: str) -> bytes:
        """Ids of a space and ``rest``."""
        ids = self.piece(" " + rest)
        if len(rest) < 64:
            if len(self.cache) >= 2 * CACHE_WORDS:
                self.cache.clear()
            self.cache[rest] = ids
        return ids

    def piece(self, text: str) -> bytes:
        known, out = self.known, []
        for w in self.words(text):
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.merge(w.encode()), "<u4").tobytes()
                if len(w) < 64:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(packed, "<u4").tolist()])

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", "replace")


_TOKENIZERS: dict[int, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    if shared.value[0] not in _TOKENIZERS:
        _TOKENIZERS[shared.value[0]] = Tokenizer(shared.value[1])
    return _TOKENIZERS[shared.value[0]]


def load(spark, path: str):
    """Broadcasts a vocabulary file; its size is that of the file, never of the data."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` as an array of integers."""
    return _mapped(df, path, text_col, {ids_col: pa.list_(pa.int32())}, lambda t, text: (t.encode(text),))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text that ``ids_col`` stands for."""
    return _mapped(df, path, ids_col, {text_col: pa.string()}, lambda t, ids: (t.decode(ids),), [])


def _digest(t: Tokenizer, text: str) -> tuple[int, str, str]:
    ids = t.packed(text)
    decoded = t.decode_bytes(ids).decode("utf-8", "replace").encode()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of an encode-decode round trip."""
    return _mapped(df, path, text_col, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, _digest)


def _mapped(df: DataFrame, path: str, source: str, added: dict[str, pa.DataType], f, null="") -> DataFrame:
    ship(df.sparkSession)
    shared = load(df.sparkSession, path)
    lower = {c.lower() for c in added}
    kept = [c for c in df.columns if c.lower() not in lower]
    given = fresh_name([*df.columns, *added], "source_")
    names = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"`{c}` {names[t]}" for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(shared)
        for batch in batches:
            rows = [f(t, null if x is None else x) for x in batch.column(len(kept)).to_pylist()]
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    from pyspark.sql import functions as F

    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*(quote(c) for c in kept), quote(source).alias(given)).mapInArrow(run, schema)
