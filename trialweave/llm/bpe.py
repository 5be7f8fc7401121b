"""Byte-level BPE encoding and decoding by a rank file.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary answers pre-tokens that are one
token as they stand; it needs one probe and no chains. All others are merged from bytes: a heap holds the
mergeable neighbours by rank and place, and a linked list holds the bytes, so each merge touches only its
neighbours. Texts are cut at single blanks first, where no pre-token can end up on both sides, and every
worker keeps the ids of pieces it has met, up to a fixed number of pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

_M64 = (1 << 64) - 1
_C1, _C2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Pieces a worker remembers in a task; beyond it the memory starts anew.
REMEMBERED = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of a fixed key set: hash and displace, one slot per key and no slot empty.

    Keys fall into buckets; buckets with several keys, largest first, look for a displacement that sends all
    their keys to free slots; the keys of one-key buckets take the slots left over.
    """

    def __init__(self, keys: dict[bytes, int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = {k: xxhash.xxh3_64_intdigest(k) for k in keys}
        members: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k, h in hashes.items():
            members[h % self.buckets].append(k)
        self.shift, self.key, self.value = [0] * self.buckets, [b""] * n, [0] * n
        free, single = bytearray(b"\1") * n, []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            ks = members[b]
            if len(ks) < 2:
                single += [b] * len(ks)
                continue
            d = 0
            while True:
                slots = {self._slot(hashes[k], d) for k in ks}
                if len(slots) == len(ks) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for k in ks:
                self._put(self._slot(hashes[k], d), k, keys[k], free)
        empty = (s for s in range(n) if free[s])
        for b, s in zip(single, list(empty), strict=True):
            self.shift[b] = -s - 1
            self._put(s, members[b][0], keys[members[b][0]], free)

    def _put(self, s: int, k: bytes, v: int, free: bytearray) -> None:
        self.key[s], self.value[s], free[s] = k, v, 0

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * _C1)) * _C2) & _M64
        return ((x >> 32) * self.n) >> 32

    def get(self, k: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(k)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.value[s] if self.key[s] == k else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token: the neighbours of lowest rank join first, ties from the left.

    Heap entries hold rank and place in one number. ``end`` is the end of the part that starts at a place, 0
    where no part starts any more; ``before`` is where the part on the left starts.
    """
    n, get = len(piece), ranks.get
    bits = n.bit_length()
    mask = (1 << bits) - 1
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r << bits) | i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i = x & mask
        j = end[i]
        # Stale unless two parts still meet here and make the token of this rank.
        if not j or j == n or get(piece[i : (stop := end[j])]) != x >> bits:
            continue
        end[i], end[j], before[stop] = stop, 0, i
        if stop < n and (r := get(piece[i : end[stop]])) is not None:
            push(heap, (r << bits) | i)
        if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
            push(heap, (r << bits) | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.whole = ranks, PerfectHash(ranks)
        self.tokens = {str(r): t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.seen: dict[str, str] = {}
        self.parts: dict[str, str] = {}
        # A blank between two characters that are not white space always starts a pre-token.
        self.blank = re.compile(r"(?<=\S) (?=\S)")
        self.odd = re.compile(r"\s\s")

    def part(self, text: str) -> str:
        """Ids of one pre-token."""
        raw = text.encode()
        one = self.whole.get(raw)
        return str(one) if one is not None else ",".join(map(str, merge(raw, self.ranks)))

    def piece(self, text: str) -> str:
        """Ids of a piece of text that no pre-token crosses."""
        out = []
        for p in self.find(text):
            ids = self.parts.get(p)
            if ids is None:
                ids = self.parts[p] = self.part(p)
            out.append(ids)
        return ",".join(out)

    def plain(self, text: str) -> bool:
        """Whether every blank stands between two characters that are not white space."""
        return not (text[0].isspace() or text[-1].isspace() or self.odd.search(text))

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        cut = text.split(" ") if self.plain(text) else self.blank.split(text)
        if len(self.seen) > REMEMBERED or len(self.parts) > REMEMBERED:
            self.forget()
        seen = self.seen
        out = [self.piece(cut[0])]
        for c in cut[1:]:
            ids = seen.get(c)
            if ids is None:
                ids = seen[c] = self.piece(" " + c)
            out.append(ids)
        return ",".join(out)

    def forget(self) -> None:
        """Workers outlive a task, and what comes next needs their memory."""
        self.seen, self.parts = {}, {}

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker, vocabulary file and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids`` (array, if wanted), ``ids_sha256`` and ``decoded_sha256``.

    Encodes every whole text, decodes the ids again and digests both. Null and empty texts have no tokens and
    the digests of nothing. Other columns pass through unchanged; new columns replace old ones of the same
    name. No rows move between tasks. ``path`` is a rank file present on every machine, as an installed
    package is. A text needs memory of a few times its own size.
    """
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in (text, *new)]
    schema = docs.select(kept).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids_digest, digest, lists = [], [], [], []
            for t in batch.column("__text"):
                ids = c.encode(t.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                ids_digest.append(hashlib.sha256(ids.encode()).hexdigest())
                digest.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.array(ids.split(",") if ids else [], np.int32))
            columns = [*[batch.column(k) for k in kept], pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(digest, pa.string())]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        c.forget()

    return docs.select(*kept, docs[text].alias("__text")).mapInArrow(run, schema)
