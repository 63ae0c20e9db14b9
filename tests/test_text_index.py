"""Searches by the index against plain containment."""

import pytest

from gatewright.operators.text_index import BUCKETS, TextIndex, _bucket_of, build_index

TEXTS = [
    ("a", "Alpha beta-gamma 12"), ("a", "Delta\tÉtoile 😀x"), ("b", "alphabet soup"), ("b", None), ("b", ""), ("c", "   "), ("d", "gam ma"), ("d", "bet"),
    ("e", "x" * 300 + "needle" + "y" * 300), ("f", "a_b%c a.b*c"), ("g", "étoile alpha gamma"), (None, "alpha gamma"), ("h", "abcabcabc"), ("h", "abcabcabc"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index") / "i")
    build_index(spark.createDataFrame(TEXTS, "k string, text string").repartition(3), ["k"], root)
    return TextIndex(spark, root, ["k"])


def plain(query):
    tokens = query.lower().split()
    keys = {k for k, t in TEXTS if k and t and t.strip()}
    return sorted(k for k in keys if all(any(w in (t or "").lower() for x, t in TEXTS if x == k) for w in tokens))


@pytest.mark.parametrize("query", ["alpha", "ALPHA gamma", "a", "é", "étoile", "needle", "x", "yyyy", "😀", "beta-gam", "b%c", "a.b", "abcabc", "bcabca",
                                   "gam ma", "nothing", "alpha nothing", "12 delta", "", "  ", "ta\tét"])
def test_index_equals_containment(index, query):
    assert sorted(r.k for r in index.search(query).collect()) == plain(query)


def test_a_search_reads_the_buckets_of_its_grams(index):
    plan = index.words_with("alpha")._jdf.queryExecution().toString()
    wanted = sorted({_bucket_of(g) for g in ("alp", "lph", "pha")})
    assert len(wanted) < BUCKETS and "PartitionFilters: [bucket#" in plan and f"IN ({','.join(map(str, wanted))})" in plan


def test_index_of_nothing(spark, tmp_path):
    index = build_index(spark.createDataFrame([(1, None), (2, " ")], "k long, text string"), ["k"], str(tmp_path / "i"))
    assert index.search("abc").count() == index.search("a").count() == index.search("").count() == 0


def test_rows_do_not_grow_with_texts_times_words(spark, tmp_path):
    texts = spark.range(3000).selectExpr("id AS k", "concat(concat_ws(' ', transform(sequence(1, 60), i -> concat('word', i))), ' own', id) AS text")
    index = build_index(texts.repartition(3), ["k"], str(tmp_path / "i"))
    rows = sum(spark.read.parquet(str(folder)).count() for folder in (tmp_path / "i").iterdir())
    assert rows < 5 * 3000  # 183,000 pairs of a text and a word
    assert [r.k for r in index.search("word7 own2999").collect()] == [2999] and index.search("WORD60").count() == 3000


def test_many_blocks_are_joined(index, monkeypatch):
    monkeypatch.setattr("gatewright.operators.text_index.NAMED_BLOCKS", 0)
    assert sorted(r.k for r in index.search("alpha gamma").collect()) == plain("alpha gamma")
