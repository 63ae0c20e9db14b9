"""A stored index for searches by parts of words.

A search word holds no blanks, so it is in a text exactly if it is in one of the text's words. The index keeps every text once, as it lies,
and numbers texts in blocks. A dictionary names the words of each block, in the order of words and in blocks of its own, and a posting table
leads from three-character grams to blocks of the dictionary. A search reads the postings of its own grams, the dictionary blocks that have
all of them and the text blocks of the words found, whatever the number of texts. Blocks are only where to look: words, and texts, are
verified. No row is kept per text and word, and nothing but dictionary rows is shuffled. A search word of one or two characters has no gram and
is looked for in the whole dictionary; so it is among words too long for grams. Nothing but the search words decides which way is taken.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.functions.text import search_tokens
from gatewright.operators.merge import union_all

GRAM, BUCKETS = 3, 64
#: Words of more characters than this are kept without grams and looked through as a whole.
LONGEST_WORD = 256
#: Rows of a block of texts and of a block of the dictionary, as powers of two.
TEXT_BITS, WORD_BITS = 14, 12
#: So many blocks are named to the files' statistics; more are joined.
NAMED_BLOCKS = 1_000

_BLANK = r"[ \t\n\x0B\f\r]+"
_WORDS = "word string, block bigint, place bigint, long boolean"


def _bucket(text: Column) -> Column:
    return F.pmod(F.crc32(text.cast("binary")), F.lit(BUCKETS)).cast("int")


def _bucket_of(text: str) -> int:
    return crc32(text.encode()) % BUCKETS


def _grams(word: str) -> list[str]:
    return sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})


def _block(bits: int) -> Column:
    """A number for every 2^bits consecutive rows of a partition; fixed once it is written."""
    return F.shiftright(F.monotonically_increasing_id(), bits)


def _stored(df: DataFrame, folder: str, *by: str) -> None:
    df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)


def build_index(texts: DataFrame, keys: list[str], root: str, text: str = "text") -> TextIndex:
    """Write the index of a table of texts to the new folder `root`; a later session opens it as TextIndex(spark, root, keys).

    keys: the columns that say whose text it is; a key may have any number of texts. NULL and blank texts add nothing. Texts are not
    shuffled: equal ones that lie near each other are stored once by the files' own dictionaries. Words are reduced to one row per block.
    """
    spark, schema = texts.sparkSession, texts.select(*keys).schema
    index = TextIndex(spark, root, keys, schema)
    some = texts.select(*keys, F.lower(F.col(text)).alias("text")).where(F.regexp_replace("text", _BLANK, "") != "")
    _stored(some.withColumn("block", _block(TEXT_BITS)), f"{root}/texts")
    words = index.texts().select(F.explode(F.array_distinct(F.split("text", _BLANK))).alias("word"), "block").where("word <> ''").distinct()
    words = words.withColumn("long", F.length("word") > LONGEST_WORD)
    order = ["long", "word", "block"]
    words = words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", _block(WORD_BITS))
    _stored(words, f"{root}/words", "long")
    grams = F.expr(f"array_distinct(transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM})))")
    short = index.words().where(~F.col("long") & (F.length("word") >= GRAM))
    postings = short.select(F.explode(grams).alias("gram"), "place").distinct().withColumn("bucket", _bucket(F.col("gram")))
    _stored(postings.repartitionByRange("bucket", "gram", "place").sortWithinPartitions("bucket", "gram"), f"{root}/postings", "bucket")
    return index


class TextIndex:
    """Searches in an index that build_index() has written. Keys are texts, unless their schema is given."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType | None = None):
        self.spark, self.root, self.keys = spark, root, keys
        own = list(schema or [T.StructField(k, T.StringType()) for k in keys])
        self.schema = T.StructType([*own, T.StructField("text", T.StringType()), T.StructField("block", T.LongType())])

    def texts(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/texts")

    def words(self) -> DataFrame:
        return self.spark.read.schema(_WORDS).parquet(f"{self.root}/words")

    def _places(self, grams: list[str]) -> DataFrame:
        """(place): the blocks of the dictionary that have all these grams."""
        of_grams = F.col("bucket").isin(sorted({_bucket_of(g) for g in grams})) & F.col("gram").isin(grams)
        postings = self.spark.read.schema("gram string, place bigint, bucket int").parquet(f"{self.root}/postings").where(of_grams)
        return postings.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("place")

    def _holding(self, token: str, near=lambda rows, wanted, column: rows.join(wanted, column, "left_semi")) -> DataFrame:
        """(word, block): the words that hold the token, with the blocks of texts they are in. near: how rows of some blocks are read."""
        words, grams = self.words(), _grams(token)
        if grams:
            words = near(words.where("NOT long"), self._places(grams), "place").unionByName(words.where("long"))
        return words.where(F.col("word").contains(token)).select("word", "block")

    def words_with(self, token: str) -> DataFrame:
        """(word): the words of the dictionary that hold the token."""
        return self._holding(token).select("word").distinct()

    def _near(self, rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
        """The rows of the wanted blocks. Few of them are looked up first, so that files and row groups without any are passed over."""
        named = [r[0] for r in wanted.limit(NAMED_BLOCKS + 1).collect()]
        return rows.where(F.col(column).isin(named)) if len(named) <= NAMED_BLOCKS else rows.join(wanted, column, "left_semi")

    def hits(self, tokens: list[str]) -> DataFrame:
        """The keys of texts that have one of the tokens, and `_hit<i>`: whether it has that one; a key may come up several times."""
        blocks = union_all([self._holding(t, self._near).select("block") for t in tokens]).distinct()
        flags = [F.col("text").contains(t).alias(f"_hit{i}") for i, t in enumerate(tokens)]
        return self._near(self.texts(), blocks, "block").select(*self.keys, *flags).where(" OR ".join(f"_hit{i}" for i in range(len(tokens))))

    def search(self, query: str, by: list[str] | None = None) -> DataFrame:
        """The values of `by` (the keys) whose texts together have every word of the query, ignoring case; all, if it has none. NULL in `by` is none."""
        by, tokens = by or self.keys, list(dict.fromkeys(search_tokens(query)))
        if not tokens:
            return self.texts().select(*by).dropna().distinct()
        flags = [f"_hit{i}" for i in range(len(tokens))]
        found = self.hits(tokens).dropna(subset=by).groupBy(*by).agg(*[F.max(f).alias(f) for f in flags])
        return found.where(" AND ".join(flags)).select(*by)
