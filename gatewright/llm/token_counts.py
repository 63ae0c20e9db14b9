"""Token counts of whole texts, huge ones by overlapping chunks.

A text of at most CHUNK code points is counted as it is. A longer one is cut into overlapping chunks, which Spark deals to tasks; each
is encoded by itself, with the offsets of its pre-tokens. A boundary between two pre-tokens is stable: matching goes on from there
looking at nothing to its left. So where two neighbouring chunks have a boundary in common, away from the later chunk's start and from
the earlier one's end, both go on alike, and by induction from the first chunk it is a boundary of the whole text: there the counts
are spliced. Where two chunks have none in common, the text's overlap is widened and it is encoded again, at last in one chunk.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.bpe import REMEMBERED, split
from gatewright.llm.common import bounded_batches, slices, stored

#: Code points of a chunk without its overlap, and of the first overlap. Each failed alignment makes both WIDER times as large.
CHUNK, OVERLAP, WIDER = 1 << 14, 256, 8
#: No match of the published patterns looks further ahead than this many code points beyond its own end.
LOOK_AHEAD = 3


class ByteLevel:
    """Counts by the `tokenizers` library, for a byte-level vocabulary whose pre-tokens are the matches of a pattern.

    Strings of the file's added tokens count as one token each, as the library takes them by default. Each new pre-token is encoded once.
    """

    def __init__(self, raw: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        before = spec["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level vocabularies without normalisation or added space have pre-tokens that stand alone")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.tokenizer = Tokenizer.from_str(raw)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.margin = LOOK_AHEAD + max(map(len, names), default=0)
        self.split, self.known = split(pattern), {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens in order, added tokens among them."""
        if self.added is None or not self.added.search(text):
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.added.split(text)):
            if k % 2:
                out.append(part)
            else:
                out += self.split(part)
        return out

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set(words))
            for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
                known[w] = len(e)
        return list(map(known.__getitem__, words))


@lru_cache(maxsize=1)
def byte_level(raw: str, pattern: str) -> ByteLevel:
    return ByteLevel(raw, pattern)


def _boundaries(own: ByteLevel, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens end, and how many tokens there are up to there; the start comes first."""
    words = own.words(text)
    return np.fromiter(accumulate(map(len, words), initial=0), np.int64), np.fromiter(accumulate(own.counts(words), initial=0), np.int64)


def _sides(own: ByteLevel, text: str, first: bool, last: bool, overlap: int) -> tuple:
    """A chunk's tokens, and the boundaries of its first and its last overlap that may be stable, as (place, tokens before)."""
    at, before = _boundaries(own, text)
    n = len(text)
    head = (at >= own.margin) & (at <= overlap - own.margin) if not first else np.zeros(len(at), bool)
    tail = (at >= n - overlap + own.margin) & (at <= n - own.margin) if not last else np.zeros(len(at), bool)
    shift = n - overlap  # where the next chunk starts
    return int(before[-1]), (at[head], before[head]), (at[tail] - shift, before[tail])


def _lists(pairs: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, pairs)]).astype("int32"), pa.array(flat, pa.int64()))


def _whole(docs: DataFrame, shared, pattern: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_level(shared.value, pattern)
        for b in slices(batches):
            n = [sum(own.counts(own.words(t))) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["n_bytes"], pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, n_bytes long, n_tokens long")


def _chunks(docs: DataFrame, step: int, overlap: int) -> DataFrame:
    """_key, at, last, chunk: the overlapping chunks of every text, dealt over tasks, copies of a text as well."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId() << 32
        for b in slices(batches, 1):
            key, text = b["_key"][0].as_py(), b["text"][0].as_py()
            n = max(1, -(-(len(text) - overlap) // step))
            for k in range(0, n, 64):  # few chunks at a time
                some = range(k, min(n, k + 64))
                texts = [text[i * step : i * step + step + overlap] for i in some]
                deals = np.arange(deal, deal + len(some))
                deal += len(some)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([i == n - 1 for i in some]), pa.array(texts, pa.string()), pa.array(deals)], ["_key", "at", "last", "chunk", "_deal"])

    return docs.select("_key", "text").mapInArrow(rows, "_key string, at int, last boolean, chunk string, _deal long").repartition("_deal").drop("_deal")


def _encoded(chunks: DataFrame, shared, pattern: str, overlap: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_level(shared.value, pattern)
        for b in slices(batches, 64):
            found = [_sides(own, t, at == 0, last, overlap) for t, at, last in zip(b["chunk"].to_pylist(), b["at"].to_pylist(), b["last"].to_pylist())]
            lists = [_lists([f[side][k] for f in found]) for side in (1, 2) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b["_key"], b["at"], b["last"], pa.array([f[0] for f in found], pa.int64()), *lists], ["_key", "at", "last", "n", "head", "head_n", "tail", "tail_n"])

    return chunks.mapInArrow(rows, "_key string, at int, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>").dropDuplicates(["_key", "at"])


def _spliced(encoded: DataFrame) -> DataFrame:
    """_key, n_tokens (null where two chunks have no boundary in common). Neighbours meet in a join by key and number."""
    following = encoded.select("_key", (F.col("at") - 1).alias("at"), "head", "head_n")
    pairs = encoded.drop("head", "head_n").join(following, ["_key", "at"], "left")
    common = F.try_element_at(F.array_intersect("tail", "head"), F.lit(1))
    pairs = pairs.withColumn("_common", common)
    left = F.element_at("tail_n", F.array_position("tail", F.col("_common")).cast("int"))
    right = F.element_at("head_n", F.array_position("head", F.col("_common")).cast("int"))
    # a chunk gives its tokens up to the splice; what the next one has before it is taken off
    part = F.when(F.col("last"), F.col("n")).when(F.col("_common").isNotNull(), left - right)
    return pairs.groupBy("_key").agg(F.when(F.count(part) == F.count("*"), F.sum(part)).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no tokens. Repeated rows and null ids repeat with equal results. Only a chunk's boundaries within its
    overlaps leave a task, never its tokens. A text whose overlaps are one pre-token is encoded again with wider ones, at last whole.
    """
    if overlap > chunk:
        raise ValueError("an overlap may not be longer than a chunk")
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    if overlap < 4 * ByteLevel(shared.value, pattern).margin:
        raise ValueError("an overlap must be longer than what pre-tokens look at")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    huge = F.col("n_bytes") > chunk + overlap  # bytes are no fewer than code points
    counted = _whole(rows.where(~huge), shared, pattern)
    # texts are known by a digest: the boundaries of equal texts are equal, and one of each is kept
    keyed = rows.where(huge).withColumn("_key", F.concat_ws(":", F.sha2(F.col("text").cast("binary"), 256), "n_bytes"))
    left, step = keyed, chunk
    done = None
    while True:
        spliced = stored(_spliced(_encoded(_chunks(left, step, overlap), shared, pattern, overlap)), "spliced")
        done = spliced if done is None else done.unionByName(spliced)
        failed = spliced.where("n_tokens is null").select("_key")
        if failed.isEmpty():
            break
        left = left.join(failed, "_key", "left_semi")
        step, overlap = step * WIDER, overlap * WIDER
    spliced_rows = keyed.select("id", "n_bytes", "_key").join(done.where("n_tokens is not null"), "_key").select("id", "n_bytes", "n_tokens")
    out = counted.unionByName(spliced_rows).withColumn("over_limit", F.col("n_tokens") > limit)
    return out.withColumnRenamed("id", id_col)
