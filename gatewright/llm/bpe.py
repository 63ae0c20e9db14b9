"""Byte-level BPE encoding and decoding.

Merges of one pre-token are ordered by a hierarchical-bitmap rank queue: each merge rank has a bucket of linked-list positions, two
levels of 256-bit words say which buckets are in use, and find-first-set on each level gives the lowest rank. A merge only links two
positions and files the two new pairs; entries whose pair has changed since are skipped when they come up. The work is near linear
in the pre-token's length, so very long pre-tokens (no spaces) are no special case.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import bounded_batches, slices

#: Pre-tokens whose ids a task remembers at most; beyond that it starts anew.
REMEMBERED = 500_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


#: Highest character of the three alphabets that a text is matched in; classes of few characters match faster.
ALPHABETS = (0x7F, 0xFFFF, sys.maxunicode)


@lru_cache(maxsize=None)
def _char_class(kind: str, top: int) -> str:
    """The body of a character class: all characters of the general category up to `top`, as ranges."""
    runs, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            runs.append(f"\\U{start:08x}" if start == c - 1 else f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(runs)


#: White space as the published pattern means it (the Unicode property, which leaves out 1C to 1F).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=None)
def splitter(pattern: str, top: int = sys.maxunicode) -> re.Pattern:
    """The pattern for `re`: \\p{L}, \\p{N}, \\s and \\S written out as character classes up to `top`."""
    space = SPACE if top > 0x7F else "\\t-\\r "
    out, i, inside = [], 0, False
    while i < len(pattern):
        if pattern.startswith(("\\p{L}", "\\p{N}"), i):
            body, step = _char_class(pattern[i + 3], top), 5
        elif pattern.startswith("\\s", i):
            body, step = space, 2
        elif pattern.startswith("\\S", i):
            out.append(f"[^{space}]")
            i += 2
            continue
        else:
            inside = {"[": True, "]": False}.get(pattern[i], inside)
            out.append(pattern[i])
            i += 1
            continue
        out.append(body if inside else f"[{body}]")
        i += step
    return re.compile("".join(out))


_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search


def split(pattern: str):
    """A function from a text to its matches."""
    ascii_, basic, full = (splitter(pattern, top).findall for top in ALPHABETS)
    return lambda text: ascii_(text) if text.isascii() else full(text) if _ASTRAL(text) else basic(text)


#: Bits of a word on each level of the bitmap.
WIDTH = 256


class Encoder:
    """Encodes texts by a rank table; one per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, split(pattern)
        self.words = [0] * (max(ranks.values(), default=0) // WIDTH + 1)  # all zero again after each pre-token
        self.bit = [1 << k for k in range(WIDTH)]
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: merges by lowest rank, leftmost first."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        words, bit, top, buckets = self.words, self.bit, 0, {}
        n = len(piece)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        fresh = [(i, rank_of(piece[i : i + 2])) for i in range(n - 1)]
        while True:
            for at, rank in fresh:
                if rank is None:
                    pair[at] = -1
                    continue
                pair[at] = rank
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    words[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
            # the next entry that is not stale
            while top:
                w = (top & -top).bit_length() - 1
                x = words[w]
                rank = w << 8 | (x & -x).bit_length() - 1
                bucket = buckets[rank]
                i = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    words[w] = x & (x - 1)
                    if not words[w]:
                        top &= top - 1
                if pair[i] == rank:
                    break
            else:
                break
            j = after[i]
            end = after[i] = after[j]
            pair[j] = -1
            left = before[i]
            fresh = [(left, rank_of(piece[left:end]))] if left >= 0 else []
            if end < n:
                before[end] = i
                fresh.append((i, rank_of(piece[i : after[end]])))
            else:
                pair[i] = -1
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        words, known = self.split(text), self.known
        new = set(words).difference(known)
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = np.array(self.merge(w.encode("utf-8")), "<i4").tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")


@lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str) -> Encoder:
    """One per worker process: what it has learned serves its later tasks as well."""
    return Encoder(parse_ranks(raw), pattern)


def list_array(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, "<i4")
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype("int32"), pa.array(flat, pa.int32()))


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """Per row: the id, `ids` (array<int>) of the whole text, each match of the pattern encoded separately, and, unless decoded
    is False, `decoded`, the bytes that these ids stand for.

    Null and empty texts have no ids and decode to no bytes. Repeated rows repeat. Special tokens are ordinary text. The rank file
    is read on the driver and broadcast (its size is the vocabulary's, under a few MB).
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_file))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        token = {i: b for b, i in own.ranks.items()}.__getitem__
        for b in slices(batches):
            ids = [own.encode(t) if t else np.zeros(0, "<i4") for t in b["text"].to_pylist()]
            columns = {"id": b["id"], "ids": list_array(ids)}
            if decoded:
                columns["decoded"] = pa.array([b"".join(map(token, x.tolist())) for x in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(rows, f"id {kind}, ids array<int>" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_file: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id and `decoded`, the bytes of the ids in order. Null or empty ids give no bytes; an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_file))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in parse_ranks(shared.value).items()}.__getitem__
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"id": b["id"], "decoded": pa.array([b"".join(map(token, x or [])) for x in b["ids"].to_pylist()], pa.binary())})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids).alias("ids")).mapInArrow(rows, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
