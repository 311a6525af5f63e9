from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def exchanges(df) -> int:
    """Hash exchanges of the plan before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def same_rows(left, right) -> bool:
    """Equality of two frames as bags of rows, whatever the column order."""
    names = sorted(left.columns)
    if names != sorted(right.columns):
        return False
    a = sorted(map(repr, left.select(names).collect()))
    b = sorted(map(repr, right.select(names).collect()))
    return a == b
