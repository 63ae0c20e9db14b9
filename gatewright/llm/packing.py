"""Best-fit packing of documents into sequences of bounded length.

Token pieces are counted by length in Spark. On that histogram (at most `capacity` numbers, whatever the corpus' size) short patterns
of lengths that fill a sequence exactly are enumerated, non-negative least squares fits how often each pattern is to be used, the fit
is rounded to what is there, and what remains is packed by best-fit decreasing. Spark then numbers the pieces of each length and
hands them their places.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.llm.bpe import REMEMBERED
from gatewright.llm.common import bounded_batches, set_aside, slices
from gatewright.llm.token_counts import ByteLevel

#: Ranks are joined to the starts of their blocks by broadcast up to this number of small rows, beyond it by a shuffle.
BROADCAST_ROWS = 1_000_000


#: Pre-tokens of these characters only are split alike by all versions of Unicode, so the vocabulary's model takes them as they are.
PLAIN = "".join(map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]))


class Tokens(ByteLevel):
    """Ids by the `tokenizers` library; texts are split as its byte-level pre-tokenizer does, each new pre-token is encoded once."""

    def __init__(self, raw: str, pattern: str):
        super().__init__(raw, pattern)
        self.piece = self.tokenizer.model.tokenize
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(32)]
        # the letters that stand for the bytes, as byte-level vocabularies have them: printable ones for themselves, the others from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = sorted(set(range(256)).difference(shown))
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.letters = {c: "".join(map(letter.__getitem__, c.encode("utf-8"))) for c in PLAIN}

    def packed(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, new: Iterable[str]) -> None:
        """Encodes pre-tokens: plain ones by the library's model alone, the others and added tokens by all its steps."""
        known, piece, letter, packed, special, id_ = self.known, self.piece, self.letters.__getitem__, self.packed, self.special, attrgetter("id")
        other = []
        for w in new:
            try:
                letters = "".join(map(letter, w))
            except KeyError:
                other.append(w)
                continue
            if w in special:
                other.append(w)
            else:
                known[w] = packed([*map(id_, piece(letters))])
        if other:
            for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
                known[w] = packed(e.ids)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, strings of added tokens as the library takes them by default."""
        split, known = [self.words(t) if t else [] for t in texts], self.known
        new = set().union(*split).difference(known)
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = set().union(*split)
            self.learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def tokens(raw: str, pattern: str) -> Tokens:
    return Tokens(raw, pattern)


def token_pieces(docs: DataFrame, tokenizer_file: str, pattern: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of every document: id, `piece` (from 0), `start`, `length`, `ids` (binary, little-endian u4).

    A document is its ids and `end_id`; null and empty texts are that one id. Longer documents are cut so that the first piece
    takes the remainder. Repeated rows give repeated pieces.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(shared.value, pattern)
        for b in slices(batches, 256):
            at, piece, start, length, ids = [], [], [], [], []
            for i, data in enumerate(own.encode_all(b["text"].to_pylist())):
                data += end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    ids.append(data[4 * x : 4 * y])
            out = [b["id"].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(rows, f"id {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("id", id_col)


def full_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths that sum to the capacity, as rows a >= b >= c; 0 stands for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for a in lengths[::-1]:
        b = np.arange(math.ceil((capacity - a) / 2), min(a, capacity - a) + 1)
        c = capacity - a - b
        keep = there[b] & there[c]
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, have: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Non-negative x that nearly minimises |A x - have|, A counting each length in each pattern (accelerated projected gradient)."""
    size = len(have)

    def forward(x):
        return sum(np.bincount(patterns[:, k], x, size) for k in range(patterns.shape[1])) * used

    def back(r):
        return r[patterns].sum(1)

    used = np.ones(size)
    used[0] = 0
    probe = np.ones(len(patterns))
    for _ in range(8):
        probe = back(forward(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(back(forward(probe))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back((forward(y) - have) * used))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pack_histogram(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences that use each; together they use every piece exactly once."""
    left = have.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    patterns = full_patterns(lengths, capacity)
    if len(patterns):
        x = fit_counts(patterns, have.astype(float))
        order = np.argsort(-x, kind="stable")
        for p, want in zip(patterns[order].tolist(), np.ceil(x[order] - 1e-9).tolist()):
            if want < 1:
                break
            p = tuple(v for v in p if v)
            n = int(min(want, *(left[v] // p.count(v) for v in p)))
            if n:
                out.append((p, n))
                for v in p:
                    left[v] -= n
    # the rest: longest first, each into the open sequences of the least sufficient room
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(room, p, n):
        if room not in open_:
            insort(rooms, room)
        open_[room].append((p, n))

    for v in np.flatnonzero(left)[::-1].tolist():
        n = int(left[v])
        while n:
            k = bisect_left(rooms, v)
            if k == len(rooms):
                fit = capacity // v
                if n >= fit:  # alone in new sequences, as many as fit
                    put(capacity - fit * v, (v,) * fit, n // fit)
                    n -= n // fit * fit
                else:
                    put(capacity - n * v, (v,) * n, 1)
                    n = 0
                continue
            room = rooms[k]
            p, m = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
            fit = min(room // v, n)
            take = min(m, n // fit)
            if m > take:
                put(room, p, m - take)
            put(room - fit * v, p + (v,) * fit, take)
            n -= take * fit
    return out + [x for group in open_.values() for x in group]


def pack(pieces: DataFrame, capacity: int, keys: list[str], length: str = "length") -> DataFrame:
    """The pieces with `sequence_id` and `offset`: sequences of at most `capacity`, gapless from 0. `pieces` has to be a stored table.

    Lengths outside 1 to capacity are an error. Equal pieces take any of the places that are due to their length. No pieces, no rows. Other columns stay; clashing names get the suffix _input.
    """
    pieces = set_aside(pieces, ["sequence_id", "offset", "_block", "_rank", "_start"])
    counted = pieces.groupBy(length).count().collect()  # at most `capacity` rows
    have = np.zeros(capacity + 1, np.int64)
    for v, n in counted:
        if v is None or not 1 <= v <= capacity:
            raise ValueError(f"length {v} is outside 1 to {capacity}")
        have[v] = n
    packed = pack_histogram(have, capacity)
    spots, base, used = [], 0, np.zeros(capacity + 1, np.int64)
    for p, n in packed:
        at = 0
        for v in p:
            spots.append((v, used[v], base, at))
            used[v] += n
            at += v
        base += n
    assert (used == have).all()
    # one small row per pattern and member: bounded by the number of patterns, not of pieces
    length_, first, sequence, offset = (np.array(z, np.int64) for z in zip(*sorted(spots))) if spots else [np.zeros(0, np.int64)] * 4
    ends = np.searchsorted(length_, np.arange(capacity + 2))
    shared = pieces.sparkSession.sparkContext.broadcast((ends, first, sequence, offset))

    blocks = max(8, math.ceil(int(have.sum()) / 100_000))
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    marked = pieces.withColumn("_block", block)
    before = Window.partitionBy(length).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(length, "_block").count().select(length, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    if np.count_nonzero(have) * blocks <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_block").orderBy(*keys)) - 1)
    ranked = ranked.join(starts, [length, "_block"]).withColumn("_rank", F.col("_rank") + F.col("_start")).drop("_block", "_start")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    names = pieces.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, first, sequence, offset = shared.value
        for b in batches:
            v, rank = b[length].to_numpy(), b["_rank"].to_numpy()
            at = np.empty(len(v), np.int64)
            for u in np.unique(v):  # few lengths repeat within a batch's blocks: batches come sorted by length
                own = v == u
                at[own] = ends[u] + np.searchsorted(first[ends[u] : ends[u + 1]], rank[own], "right") - 1
            place = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([b[c] for c in names] + place, [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(rows, schema)
