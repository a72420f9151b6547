import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glazier.plans.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_session(os.environ.get("TEST_MASTER", "local[4]"), 8)


@pytest.fixture(scope="session")
def small_tables(spark):
    from glazier.sources.fixtures import retail_tables
    return retail_tables(spark, SF_SMALL)
