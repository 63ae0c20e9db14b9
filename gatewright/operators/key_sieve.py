"""A measured, bounded set of bits that tells for most rows of a large frame that their key is not among some keys.

The frame is read where it lies: rows whose key is surely absent need no shuffle, the few others are joined exactly. A key is one bit of at
most 2^27, so what is broadcast has at most 16 MB of bits whatever the number of keys; more keys make it let more rows through, never less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import cut_lineage

#: Bits per key that are aimed at, and the smallest and largest number of bits as powers of two.
BITS_PER_KEY, LEAST, MOST = 16, 15, 27
_WORD, _PART = 6, 15  # 64 bits to a word, 512 words to a row


class KeySieve:
    """keys: a stored frame, as it is counted and read. NULL keys meet nothing in a join; they may be on either side here."""

    def __init__(self, keys: DataFrame, columns: list[str], most: int = MOST):
        self.columns = columns
        self.bits = min(most, max(LEAST, (keys.count() * BITS_PER_KEY).bit_length()))
        place = keys.select(self._place().alias("_place"))
        words = place.groupBy(F.shiftright("_place", _WORD).alias("_word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits"))
        parts = words.groupBy(F.shiftright("_word", _PART - _WORD).alias("_part")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.expr("cast(_word & 511 as int)"), "_bits"))).alias("_map"))
        self.parts = cut_lineage(parts.select("_part", F.expr("transform(sequence(0, 511), i -> coalesce(_map[i], 0L))").alias("_words")))

    def _place(self) -> Column:
        return F.xxhash64(*[F.col(c).cast("string") for c in self.columns]).bitwiseAND(F.lit((1 << self.bits) - 1))

    def _told(self, rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_place", self._place()).withColumn("_part", F.shiftright("_place", _PART))
        return placed.join(F.broadcast(self.parts), "_part", "left").withColumn(
            "_there", F.expr("coalesce((shiftright(_words[cast(shiftright(_place, 6) & 511 as int)], cast(_place & 63 as int)) & 1) = 1, false)"))

    def through(self, rows: DataFrame) -> DataFrame:
        """All rows whose key is there, and some others."""
        return self._told(rows).where("_there").select(*rows.columns)

    def rest(self, rows: DataFrame) -> DataFrame:
        """The other rows; the key of none is there."""
        return self._told(rows).where("NOT _there").select(*rows.columns)
