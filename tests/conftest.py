import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gatewright.session import local_session

    return local_session()


@pytest.fixture(scope="session")
def views(spark):
    from gatewright.sources.adapter import Views
    from gatewright.sources.tables import Tables

    return Views(Tables(spark, SMALL))
