import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spanloom.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("tests", "4", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
