"""Fill-in-middle transformation: texts are cut at two token boundaries and their parts reordered around sentinels.

The boundaries of a text are kept as a compressed set in the manner of Roaring bitmaps: positions are dealt into containers of 65,536
code points, each an array, a bitmap or a list of runs, whichever is smallest. Cumulative cardinalities say which container holds the
k-th boundary, a local select within it says where. A text is read container by container, so a very long one needs little more
than its own memory.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import bounded_batches, set_aside, slices

SPAN = 1 << 16

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Positions:
    """A container of few positions: themselves, sorted."""

    kind = "array"

    def __init__(self, at: np.ndarray):
        self.at = at.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.at[k])


class Bits:
    """A container of many positions: one bit each, with the number of bits before every 64-bit word."""

    kind = "bitmap"

    def __init__(self, mask: np.ndarray):
        full = np.zeros(SPAN, bool)
        full[: len(mask)] = mask
        self.words = np.packbits(full, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[w])
        for _ in range(k - int(self.before[w])):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1


class Runs:
    """A container of few stretches of neighbouring positions: their starts and how many positions lie before each."""

    kind = "run"

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.before = starts, np.concatenate([[0], np.cumsum(ends - starts)])

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[r]) + k - int(self.before[r])


def container(mask: np.ndarray) -> Positions | Bits | Runs:
    """The smallest of the three forms for the set positions of at most SPAN."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = int(mask.sum())
    costs = {2 * n: lambda: Positions(np.flatnonzero(mask)), SPAN // 8: lambda: Bits(mask), 2 + 4 * len(starts): lambda: Runs(starts, ends)}
    return costs[min(costs)]()


class BoundarySet:
    """The ends of a text's tokens: runs of A-Z and a-z, and every other code point by itself."""

    def __init__(self, text: str):
        self.containers, self.through = [], []
        total, last = 0, len(text) - 1
        for start in range(0, len(text), SPAN):
            # one code point more than the container says whether a run of letters goes on
            code = np.frombuffer(text[start : start + SPAN + 1].encode("utf-32-le", "surrogatepass"), "<u4")
            letter = ((code | 32) - 97 < 26) & (code < 128)
            ends = ~letter
            ends[:-1] |= ~letter[1:]
            if start + len(code) - 1 == last:
                ends[-1] = True
            ends = ends[:SPAN]
            total += int(ends.sum())
            self.containers.append(container(ends))
            self.through.append(total)

    def __len__(self) -> int:
        return self.through[-1] if self.through else 0

    def offset(self, k: int) -> int:
        """How many code points the first k tokens have."""
        if k == 0:
            return 0
        c = bisect_left(self.through, k)
        return c * SPAN + self.containers[c].select(k - 1 - (self.through[c - 1] if c else 0)) + 1


_SENTINEL = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs and `n` (tokens), `form`, `prefix_chars`, `middle_chars`, `output`.

    The sha256 of `<seed>:<id>` gives four numbers: two cuts (each modulo n + 1), whether the text is cut (below `rate` of 100) and
    whether the suffix comes first (below `spm_rate` of 100). Null and empty texts, and those that hold a sentinel, are always plain: the output is the text (empty for null), chars are null. A null id counts as an empty one. Repeated rows get equal
    results; cuts may fall together or on an end, which leaves parts empty. Columns with clashing names get the suffix _input.
    """
    bounded_batches(docs.sparkSession)
    docs = set_aside(docs, ["n", "form", "prefix_chars", "middle_chars", "output", "_digest"])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    names = docs.columns

    def cut(t: str, digest: str) -> tuple:
        bounds = BoundarySet(t)
        n = len(bounds)
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        if not t or h[2] % 100 >= rate or _SENTINEL.search(t):
            return n, "plain", None, None, t
        a, b = sorted(bounds.offset(x % (n + 1)) for x in h[:2])
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        if h[3] % 100 < spm_rate:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            found = [cut(t or "", d) for t, d in zip(b[text].to_pylist(), b["_digest"].to_pylist())]
            columns = list(zip(*found)) if found else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b[c] for c in names] + [pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = docs.withColumns({"n": F.lit(0).cast("long"), "form": F.lit(""), "prefix_chars": F.lit(0).cast("long"), "middle_chars": F.lit(0).cast("long"), "output": F.lit("")}).schema
    for field in schema.fields:
        field.nullable = True
    return docs.withColumn("_digest", digest).mapInArrow(rows, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no sentinel, and none can arise where its parts meet them, so the split is unique."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.try_element_at(parts, F.lit(k)) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
