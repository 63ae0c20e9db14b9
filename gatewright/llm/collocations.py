"""Phrase collocation mining over sorted count streams.

Phrases are counted length by length. A phrase can reach the least count only where both phrases of one word less do, so a task counts
only what a bitmap of the frequent shorter ones lets through: false positives cost work, never rows. The frequent phrases of each
length are kept as a stream of counts. Merge joins in lockstep of these streams, once in the order of what lies left (all words but
the last), once in the order of what lies right (all but the first), give every phrase the counts of its left parts, of its right
parts, and of its most frequent extensions to either side: parts of parts come along, so each length is joined with the next shorter
one only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.common import bounded_batches, stored

#: Bytes of text that a task turns into words at a time, and words whose phrases it looks at together.
BLOCK_BYTES, BLOCK_WORDS = 8 << 20, 1 << 20
#: Bits for each frequent phrase in a bitmap, and the most bits of one (32 MB): beyond that it lets more through.
BITS_EACH, MOST_BITS = 16, 1 << 28

# Upper case becomes lower case, the marks that end a piece become line feeds, tabs become spaces.
_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(10 if c in _MARKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Mixes the hash of a phrase with that of its next word.
_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def mixed(so_far: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (so_far ^ word) * _ODD
    return (x ^ (x >> _SHIFT)) * _ODD


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Bitmap:
    """Which phrases of one length may be frequent."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        bit = h & self.mask
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of the texts in order as numbers, -1 where a piece ends, and the words that the numbers stand for."""
    data = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    split = pc.split_pattern(pa.array([data], pa.large_binary()), " ").flatten().dictionary_encode()
    vocabulary = split.dictionary.to_pylist()
    number = np.arange(len(vocabulary))
    for k, w in enumerate(vocabulary):
        if w == b"\n":
            number[k] = -1
        elif w == b"":
            number[k] = -2
    numbers = number[split.indices.to_numpy()]
    return numbers[numbers != -2], vocabulary


def phrases(numbers: np.ndarray, vocabulary: list[bytes], lang: bytes, n: int, shorter: Bitmap | None) -> tuple[pa.Array, np.ndarray]:
    """The different phrases of n words that the bitmap lets through (all words for n = 1) and how often each occurs."""
    if n == 1:
        count = np.bincount(numbers[numbers >= 0], minlength=len(vocabulary))
        there = np.flatnonzero(count)
        return pa.array(vocabulary, pa.binary()).take(pa.array(there)), count[there]
    if len(numbers) < n:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    word = hashes(vocabulary)
    start = np.uint64(xxhash.xxh64_intdigest(lang))
    here = [numbers[k : len(numbers) - n + 1 + k] for k in range(n)]
    keep = np.logical_and.reduce([x >= 0 for x in here])
    here = [x[keep] for x in here]
    for k in (0, 1):  # both phrases of one word less
        h = np.full(len(here[0]), start, np.uint64)
        for x in here[k : k + n - 1]:
            h = mixed(h, word[x])
        keep = shorter.holds(h)
        here = [x[keep] for x in here]
    key = here[0].astype(np.int64)
    for x in here[1:]:  # words so far become one number below the number of places, so products stay small
        known, key = np.unique(key, return_inverse=True)
        key = key * len(vocabulary) + x
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    words = pa.array(vocabulary, pa.binary())
    columns = [words.take(pa.array(x[first])) for x in here]
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())), count


def _counted(docs: DataFrame, n: int, shorter: np.ndarray | None) -> DataFrame:
    """lang, phrase, a: how often each phrase of n words occurs in all; for n = 1 also a row of null phrase, the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(shorter) if shorter is not None else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(shared.value) if shared is not None else None
        waiting: dict[str, list[bytes]] = {}
        held = 0

        def flush():
            for lang, texts in waiting.items():
                numbers, vocabulary = word_numbers(texts)
                for at in range(0, max(len(numbers), 1), BLOCK_WORDS):
                    found, count = phrases(numbers[at : at + BLOCK_WORDS + n - 1], vocabulary, lang.encode(), n, bitmap)
                    if n == 1:
                        found, count = pa.concat_arrays([found.cast(pa.binary()), pa.array([None], pa.binary())]), np.append(count, count.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.cast(pa.string()), pa.array(count, pa.int64())], ["lang", "phrase", "a"])
            waiting.clear()

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].cast(pa.binary()).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(rows, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The bitmap of a table of phrases; what reaches the driver is the bitmap, at most MOST_BITS whatever the table's size."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_EACH * frequent.count()):
        bits *= 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [(lang.encode(), *p.encode().split(b" ")) for lang, p in zip(b["lang"].to_pylist(), b["phrase"].to_pylist())]
            if not split:
                continue
            columns = [hashes(list(c)) for c in zip(*split)]
            h = columns[0]
            for c in columns[1:]:
                h = mixed(h, c)
            bit = h & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["at", "bit"])

    found = frequent.select("lang", "phrase").mapInArrow(rows, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def count_streams(docs: DataFrame, longest: int = 4, least: int = 30, lang: str = "lang", text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """The number of words per language (`lang`, `n`), and for each length a stored stream `lang`, `phrase`, `a` of phrases with a >= least."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = stored(_counted(docs, 1, None).where(f"phrase is null or a >= {int(least)}"), "phrases")
    totals, streams = words.where("phrase is null").select("lang", F.col("a").alias("n")), [words.where("phrase is not null")]
    for n in range(2, longest + 1):
        streams.append(stored(_counted(docs, n, _bitmap(streams[-1])).where(F.col("a") >= least), "phrases"))
    return totals, streams


def _lockstep(longer: DataFrame, shorter: DataFrame, part: str, parts: Callable) -> DataFrame:
    """longer with the array `part` of the counts of its parts on one side, by a merge of two sorted streams."""
    own = shorter.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), parts(F.col("a"), F.col(part)).alias(part))
    joined = longer.join(own.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col(f"_{part}") == F.col("_phrase")))
    return joined.drop("_lang", "_phrase", f"_{part}")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, kept_share: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to `longest` words per language.

    n is the number of words, a how often the phrase occurs (overlaps included), l and r how often its two parts occur where the cut
    scores lowest (ties: the leftmost cut), score floor(2000000 * a / (l + r)) in exact decimals. Phrases within a longer one that
    occurs in `kept_share` of 100 of their places, or more, are left out: if one is, then so it is by a phrase of one word more. Order: score, a
    (largest first), phrase (bytes). A null language is `und`, a null text empty; repeated rows count again; without frequent phrases
    there are no rows.
    """
    totals, streams = count_streams(docs, longest, least, lang, text)
    empty = F.array().cast("array<long>")
    below = streams[0].withColumns({"left": empty, "right": empty})
    levels = []
    for stream in streams[1:]:
        words = F.split("phrase", " ")
        own = stream.withColumns({"_left": F.array_join(F.slice(words, 1, F.size(words) - 1), " "), "_right": F.array_join(F.slice(words, 2, F.size(words) - 1), " ")})
        own = _lockstep(own, below, "left", lambda a, left: F.concat(left, F.array(a)))  # counts of the first 1, 2, ... words
        own = _lockstep(own, below, "right", lambda a, right: F.concat(F.array(a), right))  # counts of what follows them
        below = stored(own, "phrases")
        levels.append(below)
    found = []
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            words = F.split("phrase", " ")
            sides = [F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1)]
            within = levels[k + 1].select("lang", "a", F.explode(F.array(*[F.array_join(s, " ") for s in sides])).alias("phrase"))
            most = within.groupBy("lang", "phrase").agg(F.max("a").alias("extended"))
            level = level.join(most.hint("merge"), ["lang", "phrase"], "left").where(f"extended is null or 100 * extended < {int(kept_share)} * a").drop("extended")
        found.append(level)
    kept = found[0]
    for level in found[1:]:
        kept = kept.unionByName(level)
    cut = F.explode(F.transform(F.arrays_zip("left", "right"), lambda c, k: F.struct(k.alias("k"), c["left"].alias("l"), c["right"].alias("r"))))
    scored = kept.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.k", "cut.l", "cut.r")
    scored = scored.withColumn("score", F.expr("(cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
