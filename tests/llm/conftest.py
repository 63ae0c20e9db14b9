import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"

@pytest.fixture(scope="session")
def small(spark):
    """Real documents with the awkward ones among them: null, empty, blank, very long, repeated rows and null ids."""
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    long_ = " ".join(f"word{i % 977} Ünï{i % 13}" for i in range(12_000))
    odd = [(10_001, None), (10_002, ""), (10_003, " \t\n "), (10_004, "12 34 !?"), (10_005, "one"), (10_006, "One"), (10_007, long_), (10_008, long_ + " end"), (10_009, "x" * 9000), (10_010, "é€😀" * 300), (None, "no id here at all"), (10_011, "same same")]
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in odd + odd[-1:]]
    return real.unionByName(spark.createDataFrame(rows, real.schema)).cache()


@pytest.fixture(scope="session")
def texts(small):
    """doc_id, text of all rows, collected."""
    return [(r["doc_id"], r["text"]) for r in small.collect()]


@pytest.fixture(scope="session")
def nothing(small):
    return small.where("false")
