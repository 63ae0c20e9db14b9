"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word n-grams. Each set shows a prefix: the first of its tokens in one global order, as many as are needed
so that two sets of the wanted similarity must have signatures in common. Rare tokens come first and are signatures by
themselves; frequent tokens fall into classes, and only combinations of two of a class are signatures, for which the prefix is extended
by one token per class. Sets too short for that also show combinations of as many frequent tokens, one of each class, as similar sets
have in common. Documents with a common signature are candidates; those whose parity sketches differ in more bits than
similar sets can differ in tokens are out, the others are verified on their texts.

Groups of similar documents are linked without making all pairs: every bucket of a signature is first linked to its smallest member;
only members of buckets that then still span several components are compared further, and only across components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import bounded_batches, set_aside, slices, stored
from gatewright.llm.components import components

#: A token is frequent if more documents have it; at most so many tokens are, the most frequent ones.
FREQUENT, FREQUENT_TOKENS = 64, 1 << 19
CLASSES = 8
#: Rows of ids, and rows and bytes of sketches, that may be broadcast; beyond, joins shuffle.
BROADCAST_IDS, BROADCAST_SKETCHES, BROADCAST_BYTES = 1_000_000, 400_000, 64 << 20
#: Least bits of a set's sketch: the parities of its tokens by residue. Sets differ in at least as many tokens as their sketches in bits.
#: A set has at least as many bits as tokens, so that sketches of large sets are not full of noise.
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
#: Members of a bucket that one task compares with each other.
BLOCK = 4096
_WORDS_KNOWN = 400_000


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def tokens(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []  # A-Z, and white space of ASCII, as bytes do
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > _WORDS_KNOWN:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = xxhash.xxh3_64_intdigest(w, seed=99)
        h = np.array(list(map(known.__getitem__, words)), np.uint64)
        m = len(h) - self.n + 1
        x = h[:m].copy()
        for k in range(1, self.n):
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x9E3779B97F4A7C15)
            x += h[k : k + m]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return np.unique(x)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens by their residue, as 64-bit words: a power of two times SKETCH_BITS bits, not fewer than tokens."""
    bits = SKETCH_BITS
    while bits < len(tokens):
        bits *= 2
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches, one per row, brought to the width of narrower ones: what a sketch of so few words would have been."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width), axis=1)


class Sketches:
    """The sketches of a task's rows; widths may differ."""

    def __init__(self, column: pa.ListArray):
        self.words = column.flatten().to_numpy().view(np.uint64)
        self.width = column.value_lengths().to_numpy().astype(np.int64)
        self.start = np.append(0, np.cumsum(self.width)[:-1])

    def rows(self, which: np.ndarray, width: int) -> np.ndarray:
        """The sketches of some rows of one width, as words."""
        return self.words[self.start[which][:, None] + np.arange(width)]

    def narrow(self) -> np.ndarray:
        """All sketches at the least width, column by column."""
        out = np.zeros((len(self.width), SKETCH_WORDS), np.uint64, order="F")
        for width in np.unique(self.width):
            of_width = np.flatnonzero(self.width == width)
            for some in np.array_split(of_width, 1 + len(of_width) * width // (1 << 20)):
                out[some] = folded(self.rows(some, width), SKETCH_WORDS)
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of the pairs (i, j) differ, at the smaller of both widths."""
        out = np.zeros(len(i), np.int64)
        kinds = self.width[i] << 32 | self.width[j]
        for kind in np.unique(kinds):
            x, y = int(kind) >> 32, int(kind) & 0xFFFFFFFF
            of_kind, least = np.flatnonzero(kinds == kind), min(x, y)
            for some in np.array_split(of_kind, 1 + len(of_kind) * max(x, y) // (1 << 18)):
                differing = folded(self.rows(i[some], x), least) ^ folded(self.rows(j[some], y), least)
                out[some] = np.bitwise_count(differing).sum(axis=1, dtype=np.int64)
        return out


def least_common(n: int, num: int, den: int) -> int:
    """Tokens of a set of n that any set as similar as num / den must have."""
    return -(-num * n // den)


@lru_cache(maxsize=4096)
def _common_sizes(n: int, num: int, den: int) -> tuple[int, ...]:
    """The least numbers of common tokens of a set of n and the sets that are not smaller and can be similar, up to CLASSES."""
    return tuple(sorted({c for m in range(n, den * n // num + 1) if (c := least_common(m, num, den)) <= CLASSES}))


@lru_cache(maxsize=16)
def _few_combinations(num: int, den: int) -> bool:
    """Whether all short sets have few combinations of these sizes; else their frequent tokens are signatures by themselves."""
    return all(math.comb(n, c) <= 64 for n in range(1, den * CLASSES // num + 1) for c in _common_sizes(n, num, den) if c <= n)


def _short_signatures(tokens: list[int], n: int, num: int, den: int) -> list[int]:
    """Of a set of n with these frequent tokens: what it shows if all it has in common with a similar one may be one of them per class."""
    sizes = [c for c in _common_sizes(n, num, den) if c <= len(tokens)]
    if sizes and not _few_combinations(num, den):
        return tokens
    out = []
    for size in sizes:
        for group in combinations(tokens, size):
            if len({t % CLASSES for t in group}) == size:
                h = size
                for t in group:
                    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + t) & 0xFFFFFFFFFFFFFFFF
                out.append(h)
    return out


def signatures(tokens: np.ndarray, head: int, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of a sorted token set. `frequent` is sorted; tokens below `head` are ordered by class, the others follow."""
    n = len(tokens)
    if n == 0 or den * n < num * (n + 1):  # only an equal set can be similar
        return np.zeros(0, np.uint64)
    need = n - least_common(n, num, den) + 1
    cut = int(np.searchsorted(tokens, np.uint64(head)))
    first = tokens[:cut]
    often = np.zeros(cut, bool)
    if len(frequent) and cut:
        at = np.minimum(np.searchsorted(frequent, first), len(frequent) - 1)
        often = frequent[at] == first
    out = [first[~often][:need]]
    need -= len(out[0])
    if need > 0:
        held: list[list[int]] = [[] for _ in range(CLASSES)]
        combined: list[int] = []
        for t in first[often].tolist():
            if need <= 0:
                break
            group = held[t % CLASSES]
            need -= bool(group)
            combined += [(u * 0x9E3779B97F4A7C15 + t * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF for u in group]
            group.append(t)
        if need > n - cut:
            combined += _short_signatures(first[often].tolist(), n, num, den)
        out += [np.array(combined, np.uint64), tokens[cut:][: max(0, need)]]
    return np.concatenate(out)


def _frequent_tokens(docs: DataFrame, n: int, head: int) -> np.ndarray:
    """The frequent tokens below `head`, counted over all documents; sorted. At most FREQUENT_TOKENS reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in batches:
            parts = []
            for s in slices([b]):
                for t in s["text"].to_pylist():
                    x = shingler.tokens(t)
                    parts.append(x[: int(np.searchsorted(x, np.uint64(head)))])
            token, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], ["token", "n"])

    counts = docs.select("text").mapInArrow(rows, "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    got = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def _sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of every row: id, text hash, row number, number of shingles, fingerprint and sketch of the set, signatures. A stored table."""
    head = int(min(1.0, 1.6 * (den - num) / den) * (1 << 64)) - 1
    shared = docs.sparkSession.sparkContext.broadcast(_frequent_tokens(docs, n, head))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in slices(batches):
            count, print_, sketches, sigs = [], [], [], []
            for t in b["text"].to_pylist():
                x = shingler.tokens(t)
                count.append(len(x))
                print_.append(blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sketches.append(sketch(x))
                sigs.append(signatures(x, head, shared.value, num, den).view(np.int64))
            flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sigs)]).astype(np.int32), pa.array(np.concatenate(sigs), pa.int64()))
            yield pa.RecordBatch.from_arrays([b["id"], b["hash"], b["row"], pa.array(count, pa.int64()), pa.array(print_, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), flat], ["id", "hash", "row", "n", "print", "sketch", "sigs"])

    kind = docs.schema["id"].dataType.simpleString()
    own = docs.select("id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    return stored(own.mapInArrow(rows, f"id {kind}, hash long, row long, n long, print binary, sketch array<long>, sigs array<long>"), "shingle-sets")


def _shards(members: DataFrame) -> int:
    """Tasks of about 20,000 rows: every member comes up once per block of its bucket."""
    return max(1, (members.agg(F.sum("blocks")).first()[0] or 0) // 20_000)


def _narrowed(sketch: str, width: Column) -> Column:
    """A sketch column folded to so many words, as folded() does."""
    word = lambda i: F.aggregate(F.sequence(i, F.size(sketch) - 1, width), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(F.col(sketch), k)))
    return F.when(F.size(sketch) == width, F.col(sketch)).otherwise(F.transform(F.sequence(F.lit(0), width - 1), word))


def _across(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a < b) of one bucket (`sig`) and different components whose sizes and sketches let them be similar.

    members: sig, row, component, n, sketch, blocks. Buckets are compared within tasks; those of more than BLOCK members are dealt into
    blocks, and every two blocks meet in a task.
    """
    own = F.pmod(F.xxhash64("row"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = members.withColumns({"own": own, "other": other}).withColumns({"own": F.least("own", "other"), "other": F.greatest("own", "other")})
    shards = _shards(members)

    def compare(key, rows):
        rows = rows.sort_by([("sig", "ascending"), ("own", "ascending"), ("other", "ascending"), ("row", "ascending")])
        sig, own, other, row, component, n = (rows[c].to_numpy() for c in ("sig", "own", "other", "row", "component", "n"))
        sketches = Sketches(rows["sketch"].combine_chunks())
        narrow = sketches.narrow()
        allowed = (den - num) * n
        first = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1]) | (other[1:] != other[:-1])))
        found = []
        for start, end in zip(first, np.append(first[1:], len(row))):
            for at in range(start, end, 64):
                x, y = slice(at, min(at + 64, end)), slice(at, end)
                apart = np.zeros((len(n[x]), len(n[y])), np.uint16)
                for word in narrow.T:
                    apart += np.bitwise_count(word[x, None] ^ word[None, y])
                i, j = np.nonzero((den + num) * apart.astype(np.int64) <= allowed[x, None] + allowed[None, y])
                i, j = i + at, j + at
                sizes = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
                good = sizes & (component[i] != component[j]) & (row[i] < row[j])
                i, j = i[good], j[good]
                close = (den + num) * sketches.apart(i, j) <= allowed[i] + allowed[j]
                found.append(np.stack([row[i[close]], row[j[close]]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    shard = F.pmod(F.xxhash64("sig", "own", "other"), F.lit(shards))
    return dealt.select("sig", "own", "other", "row", "component", "n", "sketch").groupBy(shard).applyInArrow(compare, "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets are as similar as num / den. `nodes`: row, hash."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct().join(nodes, "row").select("row", "hash")
    wanted = stored(wanted, "wanted")
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.xxhash64("text").alias("hash"), "text").join(F.broadcast(wanted) if small else wanted, "hash")
    texts = texts.groupBy("row").agg(F.first("text").alias("text"))  # equal texts are copies: one is enough
    texts = stored(texts, "wanted-texts")
    side_b = pairs.join(texts.toDF("b", "text_b"), "b")
    both = side_b.join(texts.toDF("a", "text_a"), "a")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent = Shingler(n), {}

        def tokens(node, text):
            x = recent.get(node)
            if x is None:
                if len(recent) > 3000:  # pairs come sorted by a, and groups of similar documents name each other often
                    recent.clear()
                x = recent[node] = shingler.tokens(text)
            return x

        for batch in slices(batches):
            keep = []
            for a, b, s, t in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["text_a"].to_pylist(), batch["text_b"].to_pylist()):
                x, y = tokens(a, s), tokens(b, t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long"), "similar")


def similar_groups(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: `id`, `hash` (of the text), `n_shingles` (size of its set), `component` (smallest id in its component), `row` and
    `first_row` (equal for one row of each component, the one of the smallest id).

    Two documents link when den * |common| >= num * |union| of their sets of n-word shingles; with fewer words the whole sequence is the
    one shingle; without words, or for null texts, the set is empty and links with nothing. Equal sets always link. Ids may repeat or be
    null: rows are kept apart by their text, null ids are never the smallest unless there is no other.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sets = _sets(docs, n, num, den)
    # equal sets are one node, named by one of their rows
    nodes = sets.where("print IS NOT NULL").groupBy("print").agg(
        F.min(F.struct("row", "hash", "n")).alias("one"), F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("least"), F.first("sketch").alias("sketch"), F.first("sigs").alias("sigs"))
    nodes = nodes.select("print", "one.row", "one.hash", "one.n", "least", "sketch", "sigs")
    posted = nodes.select("row", F.explode("sigs").alias("sig"))
    shared = posted.groupBy("sig").agg(F.count("*").alias("size"), F.min("row").alias("lead")).where("size > 1")
    buckets = stored(posted.join(shared.select("sig", "lead"), "sig"), "buckets")
    known = stored(nodes.drop("sigs"), "nodes")

    sketches = known.select("row", "n", "sketch")
    count, size = sketches.agg(F.count("*"), F.coalesce(F.sum(F.size("sketch") * 8), F.lit(0))).first()
    small = count <= BROADCAST_SKETCHES and size <= BROADCAST_BYTES

    def close(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sizes and sketches let them be similar."""
        for side in ("a", "b"):
            own = sketches.toDF(side, f"n_{side}", f"sketch_{side}")
            pairs = pairs.join(F.broadcast(own) if small else own, side)
        n_a, n_b = F.col("n_a"), F.col("n_b")
        width = F.least(F.size("sketch_a"), F.size("sketch_b"))
        apart = F.aggregate(F.zip_with(_narrowed("sketch_a", width), _narrowed("sketch_b", width), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        sizes = F.lit(den) * F.least(n_a, n_b) >= F.lit(num) * F.greatest(n_a, n_b)
        return pairs.where(sizes & (F.lit(den + num) * apart <= F.lit(den - num) * (n_a + n_b))).select("a", "b")

    to_lead = buckets.where("row <> lead").select(F.col("lead").alias("a"), F.col("row").alias("b")).distinct()
    tried = stored(close(to_lead), "pairs")
    linked = _verified(docs, tried, known, n, num, den)
    label = components(linked, "a", "b").toDF("row", "component")

    marked = buckets.join(label, "row", "left").withColumn("component", F.coalesce("component", "row"))
    split = marked.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    # similar documents share many signatures: buckets of one smallest member are compared together, each pair once
    joint = marked.join(split, "sig").select(F.col("lead").alias("sig"), "row", "component").distinct()
    sizes = joint.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    open_ = stored(joint.join(sizes, "sig"), "open-buckets")
    across = stored(_across(open_.join(F.broadcast(sketches) if small else sketches, "row"), num, den), "across")
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(across.join(done, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        linked = linked.union(_verified(docs, more, known, n, num, den))
        label = components(linked, "a", "b").toDF("row", "component")

    named = known.join(label, "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    group = stored(named.join(least.toDF("component", "all_least"), "component").select("print", F.col("all_least.id").alias("component"), F.col("all_least.row").alias("first_row")), "groups")
    return sets.drop("sigs").join(group, "print", "left").select(
        "id", "hash", F.col("n").alias("n_shingles"), F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"),
        "row", F.coalesce("first_row", "row").alias("first_row"))


def first_of_groups(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of similar_groups() the row of the smallest id; all columns. Rows without any word are all kept.

    The rows that go are looked up by id and text hash: by broadcast while they are few, else by a shuffle.
    """
    docs = set_aside(docs, ["_hash"])
    found = similar_groups(docs, n, num, den, id_col, text)
    first = F.max(F.col("row") == F.col("first_row"))
    keys = stored(found.groupBy("id", "hash").agg(first.alias("first"), F.count("*").alias("n"), F.max("n_shingles").alias("words")).where("words > 0 AND (NOT first OR n > 1)"), "removals")
    marked = docs.withColumn("_hash", F.xxhash64(text))

    def join(left, right, how):
        right = right.select(F.col("id").alias("_id"), F.col("hash").alias("_h"))
        return left.join(F.broadcast(right) if keys.count() <= BROADCAST_IDS else right, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), how)

    kept = join(marked, keys, "left_anti")
    again = keys.where("first AND n > 1")  # equal ids and equal texts: one of the rows stays
    if not again.isEmpty():
        kept = kept.union(join(marked, again, "left_semi").dropDuplicates([id_col, "_hash"]))
    return kept.drop("_hash")
