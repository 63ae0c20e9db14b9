"""Removal of long repeated byte strings with suffix orders built by induced sorting.

A string of `length` bytes occurs twice only if both places show the same anchors: positions whose 8-byte gram is the smallest of some
run of grams. Every string has an anchor near its start, and the bytes after it (its core) are in all occurrences. So places are dealt
by the hash of their core, and each shard holds the windows (what lies left and right of the core) of its cores:

* anchors whose core is unique in the corpus are dropped;
* windows that are equal as a whole prove each other and are kept once, with the mark that they repeat;
* of the different windows of a shard, the suffixes at the anchors are sorted by a suffix array: suffixes are classified, the
  leftmost-smaller substrings are sorted, recursively, and the rest is induced, with permuted common prefixes. Its symbols are blocks
  of bytes. The order of the suffixes one byte further left is induced from that of the suffixes before them, for all windows at
  once, up to the leftmost start that a string around the anchor can have; neighbours in an order show what repeats.

Cores with very many different windows, as at the edge of a passage that a large part of the corpus quotes, are not put in one shard:
their strings are counted one by one in Spark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.common import bounded_batches, set_aside, slices, stored

#: Makes of batches with texts' size and bytes, and other columns, batches with the size and bytes of what is to be searched.
Code = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

GRAM = 8
#: Windows that one shard takes; different windows of one core beyond which they are counted in Spark instead.
SHARD_WINDOWS, HOT_WINDOWS = 8192, 50_000
#: Bytes of a symbol of the shards' suffix arrays.
BLOCK = 24
#: Spans, and windows asked of texts, up to which they are broadcast (some tens of bytes each); beyond it joins shuffle.
BROADCAST_ROWS, BROADCAST_WINDOWS = 1_000_000, 2_000_000
_rng = np.random.default_rng(2024)
_TABLE32 = _rng.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_TABLES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


# --- suffix arrays ---------------------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of whole numbers from 1 up, by induced sorting; the end counts as smallest."""
    return _sort(np.append(s, 0).astype(np.int32), int(s.max(initial=0)) + 1)[1:]


def _sort(s: np.ndarray, size: int) -> np.ndarray:
    n = len(s)
    if n <= 2:
        return np.argsort(s, kind="stable")
    # smaller-type suffixes: less than the next one; equal symbols take the type of the next unequal pair
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(step[np.minimum(ahead, n - 2)] > 0, True)
    small[:-1] &= ahead < n
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s, minlength=size)
    tails = np.cumsum(counts)
    heads = tails - counts
    symbols = s.tolist()
    larger_before = np.append(False, ~small[:-1])  # the suffix one to the left is larger-type
    before = larger_before.tolist()

    def induce(starts: list[int]) -> list[int]:
        out, tail = [-1] * n, tails.tolist()
        for i in reversed(starts):
            c = symbols[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = heads.tolist()
        for i in out:  # the list grows ahead of the reader
            if i > 0 and before[i]:
                c = symbols[i - 1]
                out[head[c]] = i - 1
                head[c] += 1
        tail = tails.tolist()
        for k in range(n - 1, -1, -1):
            i = out[k]
            if i > 0 and not before[i]:
                c = symbols[i - 1]
                tail[c] -= 1
                out[tail[c]] = i - 1
        return out

    first = np.array(induce(lms.tolist()))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    ends = np.empty(n, np.int64)
    ends[lms] = np.append(lms[1:], n - 1)
    raw, name, names = s.tobytes(), 0, np.zeros(n, np.int32)
    last = None
    for i, e in zip(order.tolist(), ends[order].tolist()):
        part = raw[4 * i : 4 * e + 4]
        if part != last:
            name += 1
            last = part
        names[i] = name - 1
    reduced = names[lms]
    if name == len(lms):
        sorted_lms = order
    else:
        sorted_lms = lms[_sort(reduced, name)]
    return np.array(induce(sorted_lms.tolist()))


def common_prefixes(text: list[int], sa: np.ndarray) -> np.ndarray:
    """Per position (not rank) the length of the prefix shared with the suffix sorted just before it."""
    n = len(sa)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    out, k = [0] * n, 0
    for i, j in enumerate(phi.tolist()):
        if j < 0:
            k = 0
            continue
        end = n - max(i, j)
        while k < end and text[i + k] == text[j + k]:
            k += 1
        out[i] = k
        if k:
            k -= 1
    return np.array(out)


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(-1, width)


def sort_anchors(core: np.ndarray, right: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows in the order of (core, bytes after it), and how many of these bytes each shares with the one before; -1 across cores."""
    n, blocks = len(core), -(-reach // BLOCK)
    data, sizes = _padded(right, blocks * BLOCK), np.array([len(x) for x in right])
    _, rank = np.unique(data.reshape(-1, BLOCK).copy().view(f"V{BLOCK}").ravel(), return_inverse=True)
    _, group = np.unique(core, return_inverse=True)
    rows = np.ones((n, blocks + 2), np.int64)  # the last symbol, 1, ends a window
    rows[:, 1:-1] = rank.reshape(n, blocks) + 2
    rows[:, 0] = group + rows.max() + 1  # larger than all others: windows sort last, next to each other
    flat = rows.ravel()
    sa = suffix_array(flat)
    order = sa[-n:] // (blocks + 2)
    same = common_prefixes(flat.tolist(), sa)[sa[-n:]] - 1
    same[0] = -1
    shared = np.minimum(same, blocks) * BLOCK
    part = np.flatnonzero((same >= 0) & (same < blocks))
    column = same[part, None] * BLOCK + np.arange(BLOCK)
    equal = data[order[part, None], column] == data[order[part - 1, None], column]
    shared[part] += np.logical_and.accumulate(equal, 1).sum(1)
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    shared[same < 0] = -1
    return order, shared


def repeated_starts(core: np.ndarray, left: list[bytes], right: list[bytes], reach: int) -> np.ndarray:
    """(window, l): the string that starts l bytes before the window's anchor and has reach - l bytes after its core is in another
    window of the core, too. `left` and `right`: up to `reach` bytes before and after the core."""
    order, shared = sort_anchors(core, right, reach)
    n = len(order)
    before = _padded([x[::-1] for x in left], reach) if reach else np.zeros((n, 0), np.uint8)
    sizes = np.array([len(x) for x in left])
    lowest = [shared]  # of runs of 1, 2, 4, ... neighbours
    while 2 << (len(lowest) - 1) <= n:
        step = 1 << (len(lowest) - 1)
        lowest.append(np.minimum(lowest[-1][:-step], lowest[-1][step:]))
    tall = np.zeros((len(lowest), n), np.int64)
    for k, x in enumerate(lowest):
        tall[k, : len(x)] = x
    log = np.zeros(n + 1, np.int64)
    log[1:] = np.log2(np.arange(1, n + 1)).astype(np.int64)
    at, group = np.arange(n), np.cumsum(shared < 0)  # places in the order; equal bytes from the string's start to the core
    found = []
    for l in range(reach + 1):
        if l:
            keep = sizes[order[at]] >= l
            at, group = at[keep], group[keep]
            key = (group << 8) | before[order[at], l - 1]
            induced = np.argsort(key, kind="stable")
            at, key = at[induced], key[induced]
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(key) else key
        pair = np.flatnonzero(group[1:] == group[:-1])
        if not len(pair):
            break
        a, z = at[pair] + 1, at[pair + 1]
        k = log[z - a + 1]
        common = np.minimum(tall[k, a], tall[k, z + 1 - (1 << k)])
        hit = pair[common >= reach - l]
        both = np.unique(np.concatenate([hit, hit + 1]))
        found.append(np.stack([order[at[both]], np.full(len(both), l)], 1))
        company = np.unique(np.concatenate([pair, pair + 1]))
        at, group = at[company], group[company]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


# --- anchors ---------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sliding(fn, x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(x) - width + 1
    while size * 2 <= width:
        x = fn(x[:-size], x[size:])
        size *= 2
    return fn(x[:n], x[width - size : width - size + n])


class Anchors:
    """Anchors of texts put one after another; those near a text's end that no full string can have are left out.

    A string has an anchor at most `reach` bytes from its start, and at least `core` bytes from there on.
    """

    def __init__(self, length: int):
        self.length, self.reach = length, length // 2 - GRAM
        self.core = length - self.reach

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """text number, position, hash of the core, hash of the window, for every anchor of every text."""
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        b = np.frombuffer(b"".join(texts), np.uint8)
        none = tuple(np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64))
        width = self.reach + 1
        if len(b) < width + GRAM:
            return none
        h = _TABLE32[b]
        for k, m in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
            h = h[:-k] * np.uint32(m) + h[k:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        low = _sliding(np.minimum, h, width)
        pad = np.zeros(width - 1, np.uint32)
        best = _sliding(np.maximum, np.concatenate([pad, low, pad]), width)
        at = np.flatnonzero(best == h)
        text = np.searchsorted(ends, at, "right")
        start, end = ends[text] - sizes[text], ends[text]
        keep = at + self.core <= end
        at, text, start, end = at[keep], text[keep], start[keep], end[keep]
        if not len(at):
            return none
        n = 1 << int(len(b)).bit_length()
        hashes = []
        for table, base, a, z in ((_TABLES[0], _BASES[0], at, at + self.core), (_TABLES[1], _BASES[1], np.maximum(start, at - self.reach), np.minimum(end, at + self.length))):
            up, down = _powers(base, n)
            p = np.append(np.uint64(0), np.cumsum(table[b] * up[: len(b)]))
            x = (p[z] - p[a]) * down[a] + (z - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at - a).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            x ^= x >> np.uint64(32)
            hashes.append((x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
        return text.astype(np.int32), at - start, hashes[0], hashes[1]


def _groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts' bytes, half a MB at a time or one text."""
    for b in slices(batches):
        data = b["bytes"].to_pylist()
        first = size = 0
        for k, t in enumerate(data):
            if k > first and size + len(t) > most:
                yield b.slice(first, k - first), data[first:k]
                first, size = k, 0
            size += len(t)
        if len(data) > first:
            yield b.slice(first), data[first:]


def _spans(rows: DataFrame) -> DataFrame:
    """key, size, start, end: per text its spans, with overlapping and touching ones made one."""
    order = Window.partitionBy("key", "size").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.distinct().withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("key", "size", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def repeated_spans(texts: DataFrame, length: int, code: Code | None = None) -> DataFrame:
    """key, size, start, end of the maximal runs of bytes that are covered by strings of `length` bytes which start anywhere else too.

    `texts`: key (a hash of the text), size (its bytes), bytes. Equal texts have equal keys and get one set of spans. With `code`, what is
    searched, and measured by size, start and end, is what it makes of the texts. It runs in the workers that search: a Python function of
    its own before theirs would take a second worker for every task, and workers keep what they have learned.
    """
    finder = Anchors(length)
    if not code:
        texts = texts.where(F.col("size") >= length)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in code(batches) if code else batches:
            yield b.filter(pc.greater_equal(b["size"], length))

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _groups(searched(batches)):
            core, n = np.unique(finder.find(data)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(n)], ["core", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in _groups(searched(batches)):
            text, at, core, window = finder.find(data)
            own = b.select(["key", "size"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([own["key"], own["size"], pa.array(at), pa.array(core), pa.array(window)], ["key", "size", "at", "core", "window"])

    twice = stored(texts.mapInArrow(cores, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core"), "cores")
    hits = stored(texts.mapInArrow(places, "key long, size long, at long, core long, window long").join(twice, "core"), "anchors")

    windows = hits.groupBy("core", "window").agg(F.count("*").alias("n"), F.min(F.struct("key", "size", "at")).alias("one"))
    windows = stored(windows.select("core", "window", "n", "one.*"), "windows")
    proven = hits.join(windows.where("n > 1").select("core", "window"), ["core", "window"], "left_semi")
    whole = proven.select("key", "size", F.greatest(F.col("at") - finder.reach, F.lit(0)).alias("start"), F.least(F.col("at") + length, "size").alias("end"))

    # windows that have company in their core, if one of them is alone of its kind
    mixed = windows.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("core", "kinds")
    open_ = stored(windows.join(mixed, "core").select("key", "size", "at", "core", "kinds"), "open-windows")
    asked = stored(open_.groupBy("key", F.col("size").alias("wanted")).agg(F.collect_list(F.struct("at", "core", "kinds")).alias("asked")), "asked")
    n_open, n_hot = open_.agg(F.count("*"), F.count_if(F.col("kinds") > HOT_WINDOWS)).first()
    small = n_open <= BROADCAST_WINDOWS
    reach, core_size = finder.reach, finder.core

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # copies of a text give the same windows; one of each task is enough
        for b, data in _groups(b.filter(pc.equal(b["size"], b["wanted"])) for b in searched(batches)):
            out = []
            for key, size, asked, t in zip(b["key"].to_pylist(), b["size"].to_pylist(), b["asked"].to_pylist(), data):
                if (key, size) in done:
                    continue
                done.add((key, size))
                for a in asked:
                    at = a["at"]
                    end = at + core_size
                    out.append((key, size, at, a["core"], a["kinds"], t[max(0, at - reach) : at], t[at:end] if a["kinds"] > HOT_WINDOWS else None, t[end : at + length]))
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "size", "at", "core", "kinds", "left", "middle", "right"])

    asking = texts.join(F.broadcast(asked) if small else asked, "key")
    if not code:
        asking = asking.where("size = wanted")
    pieces = asking.mapInArrow(cut, "key long, size long, at long, core long, kinds long, left binary, middle binary, right binary")
    shards = max(1, math.ceil((n_open - n_hot) / SHARD_WINDOWS))

    def search(key, rows):
        rows = rows.sort_by([("core", "ascending"), ("key", "ascending"), ("size", "ascending"), ("at", "ascending")])
        keys, sizes, at, core = (rows[c].to_numpy() for c in ("key", "size", "at", "core"))
        new = np.append(True, (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1]) | (at[1:] != at[:-1]))
        keys, sizes, at, core, rows = keys[new], sizes[new], at[new], core[new], rows.filter(pa.array(new))
        found = repeated_starts(core, rows["left"].to_pylist(), rows["right"].to_pylist(), reach)
        w, l = found[np.lexsort((found[:, 1], found[:, 0]))].T
        first = np.append(True, (w[1:] != w[:-1]) | (l[1:] != l[:-1] + 1)) if len(w) else np.zeros(0, bool)
        last = np.append(first[1:], True) if len(w) else first
        a, z = w[first], w[last]
        return pa.table([pa.array(keys[a]), pa.array(sizes[a]), pa.array(at[z] - l[last]), pa.array(at[a] - l[first] + length)], ["key", "size", "start", "end"])

    cold = pieces.where(F.col("kinds") <= HOT_WINDOWS).drop("middle", "kinds")
    by_order = cold.groupBy(F.pmod(F.xxhash64("core"), F.lit(shards))).applyInArrow(search, "key long, size long, start long, end long")
    found = whole.union(by_order)
    if n_hot:  # the strings of hot cores, one by one
        every = pieces.where(F.col("kinds") > HOT_WINDOWS).dropDuplicates(["key", "size", "at"])
        joined, first = F.concat("left", "middle", "right"), F.col("at") - F.octet_length("left")
        every = every.select("key", "size", first.alias("first"), joined.alias("bytes")).where(F.octet_length("bytes") >= length)
        each = every.select("key", "size", "first", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("o"))
        each = each.select("key", "size", (F.col("first") + F.col("o")).alias("start"), F.md5(F.substring("bytes", F.col("o") + 1, F.lit(length))).alias("string"))
        place = F.struct("key", "size", "start")
        again = each.groupBy("string").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("string")
        found = found.union(each.join(again, "string").select("key", "size", "start", (F.col("start") + length).alias("end")))
    return _spans(found)


#: A word, and the bytes of a word's code.
WORD, CODE = re.compile(rb"[^\x20\x09-\x0D]+"), 8


def word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in which every word is a 64-bit hash: strings of w words are strings of w * CODE bytes, whatever parts the words."""
    known: dict[bytes, bytes] = {}
    for b, data in _groups(batches):
        coded = []
        for t in data:
            words = t.split()  # of bytes: at the white space that parts WORDs
            known.update((w, xxhash.xxh64_digest(w)) for w in words if w not in known)
            coded.append(b"".join(map(known.__getitem__, words)))
        if len(known) > 100_000:
            known.clear()
        new = {"size": pa.array(map(len, coded), pa.int64()), "bytes": pa.array(coded, pa.binary())}
        yield pa.RecordBatch.from_arrays([new.get(c, b[c]) for c in b.schema.names], b.schema.names)


def _with_passages(text: bytes, spans: list[dict], passages: list[dict] | None) -> list[dict]:
    """The spans and those of the passages (in bytes of the text's codes), overlapping and touching ones made one."""
    if not passages:
        return spans
    words = [m.span() for m in WORD.finditer(text)]
    found = [(s["start"], s["end"]) for s in spans]
    for p in passages:
        first, end = -(-p["start"] // CODE), p["end"] // CODE
        if p["size"] == len(words) * CODE and first < end:
            found.append((words[first][0], words[end - 1][1]))
    out: list[dict] = []
    for start, end in sorted(found):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


SPANS, PASSAGES = "array<struct<start:bigint,end:bigint>>", "array<struct<size:bigint,start:bigint,end:bigint>>"


#: Columns that remove_repeats() adds, and those that it uses in between.
OWN, INNER = ["n_bytes", "spans", "kept", "kept_text"], ["_key", "_size", "_bytes", "_passages"]


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", words: int = 0) -> DataFrame:
    """All rows and columns of docs, with `n_bytes`, `spans` (array of start, end; maximal removed runs), `kept` (remaining bytes) and
    `kept_text` (the same as text, without characters of which a cut has left only a part).

    Bytes are those of the text in UTF-8, none for null. A byte goes if a string of `length` bytes over it starts anywhere else, in
    whatever text; strings are judged on the input. Texts that occur twice and are long enough go whole. With `words`, strings of so many
    words (and the white space between them) that start anywhere else go too, however short they are; at least 5. Clashing input columns
    get the suffix _input.
    """
    own = OWN
    bounded_batches(docs.sparkSession)
    docs = set_aside(docs, [*own, *INNER])
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.xxhash64(data).alias("key"), F.octet_length(data).cast("long").alias("size"), data.alias("bytes"))
    spans = repeated_spans(texts, length)
    listed = stored(spans.groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    many = listed.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    listed = listed.toDF("_key", "_size", "spans")
    keyed = docs.withColumn("_key", F.xxhash64(data)).withColumn("_size", F.octet_length(data).cast("long"))
    joined = keyed.join(F.broadcast(listed) if many <= BROADCAST_ROWS else listed, ["_key", "_size"], "left")
    if words:
        passages = repeated_spans(texts, words * CODE, word_codes)
        passages = stored(passages.groupBy("key").agg(F.collect_list(F.struct("size", "start", "end")).alias("_passages")), "passages")
        many = passages.agg(F.coalesce(F.sum(F.size("_passages")), F.lit(0))).first()[0]
        passages = passages.withColumnRenamed("key", "_key")
        joined = joined.join(F.broadcast(passages) if many <= BROADCAST_ROWS else passages, "_key", "left")
    else:
        joined = joined.withColumn("_passages", F.lit(None).cast(PASSAGES))
    joined = joined.drop("_key")
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, cuts = [], []
            for t, spans, passages in zip(b["_bytes"].to_pylist(), b["spans"].to_pylist(), b["_passages"].to_pylist()):
                spans = _with_passages(t, spans, passages)
                cuts.append(spans)
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(t)]
                kept.append(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2])))
            whole = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), b["_size"], pa.array(cuts, b["spans"].type), pa.array(kept, pa.binary()), whole], [*names, *own])

    none = F.array().cast(SPANS)
    schema = joined.select(*names, F.col("_size").alias("n_bytes"), F.coalesce("spans", none).alias("spans"), data.alias("kept"), data.cast("string").alias("kept_text")).schema
    return joined.withColumn("spans", F.coalesce("spans", none)).withColumn("_bytes", data).mapInArrow(rows, schema)
