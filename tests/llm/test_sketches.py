"""Parity sketches: never further apart than the sets are, at any widths, in numpy and in Spark; long texts are compared by wide ones."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gatewright.llm import shingles as s


def some_sets(seed, sizes):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, max(sizes, default=0) * 2 + 1, dtype=np.uint64)
    return [np.unique(rng.choice(pool, n, replace=False)) for n in sizes]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.sampled_from([0, 1, 3, 500, 512, 513, 1000, 1025, 3000]), min_size=2, max_size=6))
def test_bits_apart_never_exceed_tokens_apart(seed, sizes):
    sets = some_sets(seed, sizes)
    sketches = s.Sketches(pa.array([s.sketch(x) for x in sets], pa.list_(pa.int64())))
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = sketches.apart(i, j)
    assert all(k <= len(np.setxor1d(sets[x], sets[y])) for k, x, y in zip(apart, i, j))
    assert all(k == 0 for k, x, y in zip(apart, i, j) if x == y)
    narrow = sketches.narrow()
    assert narrow.shape == (len(sets), s.SKETCH_WORDS)
    assert all(np.bitwise_count(narrow[x] ^ narrow[y]).sum() <= k for k, x, y in zip(apart, i, j))


def test_large_sets_that_have_little_in_common_are_told_apart():
    a, b = some_sets(7, [6000, 6000])
    sketches = s.Sketches(pa.array([s.sketch(a), s.sketch(b)], pa.list_(pa.int64())))
    bits = int(sketches.apart(np.array([0]), np.array([1]))[0])
    assert (100 + 80) * bits > (100 - 80) * (len(a) + len(b))  # at least 8,192 bits: out at a similarity of 0.8 already


def test_folding_in_spark_equals_folding_in_numpy(spark):
    sets = some_sets(3, [0, 2, 700, 2000])
    rows = spark.createDataFrame([(k, s.sketch(x).tolist()) for k, x in enumerate(sets)], "k int, sketch array<long>")
    for width in (8, 16):
        got = rows.where(F.size("sketch") >= width).select("k", s._narrowed("sketch", F.lit(width)).alias("w")).collect()
        for r in got:
            want = s.folded(s.sketch(sets[r.k])[None, :], width)[0]
            assert r.w == want.tolist()


def test_long_texts_link_as_brute_force_says(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 400, 3000)
    texts = []
    for changed in (0, 20, 60, 110, 400, 3000):  # words replaced at single places: each costs up to three shingles
        words = base.copy()
        words[rng.choice(3000, changed, replace=False)] += 1000
        texts.append(" ".join(f"w{x}" for x in words))
    texts += ["short text here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component for r in s.similar_groups(docs, 3, 90, 100).collect()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in enumerate(texts) if (w := (t or "").split())}
    root = {k: k for k in range(len(texts))}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert len(set(root.values())) > 4
