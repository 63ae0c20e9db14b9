"""Merges, first and last rows per key and joined texts move their rows once."""

from pyspark.sql import functions as F

from gatewright.operators import merge as m
from gatewright.operators.textroll import text_pieces
from gatewright.plans import imports as im


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_source_of_many_keys_is_not_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(m, "cut_lineage", lambda df: stored.append(df) or df)
    target = spark.range(100).select("id", F.lit("old").alias("a"))
    source = spark.range(50, 1050).select("id", F.lit("new").alias("a"), F.lit(1).alias("at"))
    out = m.merge(target, source, ["id"], order=["at"], small_source_rows=10)
    assert not stored
    assert out.groupBy("a").count().orderBy("a").collect() == [("new", 1000), ("old", 50)]
    m.merge(target, source.limit(5), ["id"], order=["at"], small_source_rows=10)
    assert len(stored) == 1


def test_rows_per_key_are_carried_once(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "c"), (1, 4, "z"), (2, None, None), (2, None, "x")], "k int, at int, v string")
    last, first = m.latest_per_key(df, ["k"], ["at"]), m._first_per_key(df, ["k"], ["at"])
    assert sorted(map(tuple, last.collect())) == [(1, 5, "c"), (2, None, "x")]
    assert sorted(map(tuple, first.collect())) == [(1, 4, "z"), (2, None, None)]
    assert "max_by" not in executed(last) and "min_by" not in executed(first)


def test_maps_have_no_order_of_their_own(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, map('a', 1)), (1, 2, map('b', 2)) t(k, at, v)")
    assert m.latest_per_key(df, ["k"], ["at"]).first().v == {"b": 2}
    assert m._first_per_key(df, ["k"], ["at"]).first().v == {"a": 1}


def test_texts_of_short_keys_are_shuffled_once(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    pieces = text_pieces(df, ["k"], F.col("id").cast("string"), ["id"])
    assert executed(pieces).count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in executed(pieces)
    assert pieces.where("k = 7").first().text == " ".join(str(i) for i in range(7, 1000, 50))


def test_long_and_short_keys_and_none_at_all(spark):
    df = spark.range(30).select(F.when(F.col("id") < 25, F.when(F.col("id") < 20, 1).otherwise(2)).alias("k"), "id")
    got = {(r.k, r.piece): r.text.split() for r in text_pieces(df, ["k"], F.col("id").cast("string"), ["id"], piece_rows=8).collect()}
    want = {(1, 0): range(8), (1, 1): range(8, 16), (1, 2): range(16, 20), (2, 0): range(20, 25), (None, 0): range(25, 30)}
    assert got == {k: [str(i) for i in v] for k, v in want.items()}


def test_the_parts_of_a_copy_are_had_one_by_one(spark):
    answers = spark.createDataFrame([("a", "p", "r", "old", "1"), ("b", "q", "r", "kept", "1")],
                                    "answer_id string, data_product_id string, requirement_id string, answer_value string, updated_at string")
    new = answers.where("data_product_id = 'p'").withColumns({"answer_value": F.lit("new"), "updated_at": F.lit("2")})
    assert sorted(r.answer_value for r in im.copied_answers(answers, new).collect()) == ["kept", "new"]
