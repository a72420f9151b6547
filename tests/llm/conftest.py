import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_tables import tables  # noqa: E402


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), keep=False)
