"""Broadcast only what was measured.

The library gives no unconditional broadcast hints on data: literal dimensions are local relations whose size
Catalyst knows, file-backed dimensions are judged by Catalyst statistics and again by adaptive execution. Where a
small side lets a plan skip the shuffle of a huge table altogether, its rows and bytes are counted first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """True if the frame has at most `rows` rows of together at most `size` bytes as text.

    Rows are counted where they are and sized only if they are few: limit() would first bring `rows` rows of every partition to one task.
    """
    if df.agg(F.count(F.lit(1))).first()[0] > rows:
        return False
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.coalesce(F.sum(text), F.lit(0))).first()[0] <= size


def few_keys(df: DataFrame, keys: list[str], rows: int) -> bool:
    """Whether a frame may have at most `rows` different keys, as estimated where the rows are, without a shuffle of rows."""
    return df.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] <= 1.2 * rows
