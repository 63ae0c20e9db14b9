"""Plan-time metadata and size checks are bounded."""

import pytest

from gatewright import model
from gatewright.sizing import is_small


def test_rules_are_read(views):
    rules = model.load_rules(views.requirements)
    assert {r.rule_id for r in rules} == {r.rule_id for r in model.RULES}
    assert [r.required for r in rules if r.key == "lynx_pm_user_id"] == [False]


def test_small_means_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS t")
    assert is_small(df)
    assert not is_small(df, rows=99)
    assert not is_small(df, size=5000)


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from gatewright.session import checkpoint_dir

    assert checkpoint_dir(spark) == checkpoint_dir(spark)
