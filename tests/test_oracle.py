"""Every registered query next to its SQL twin, and the contract of the entry module."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from check_oracle import connect, differences  # noqa: E402
from tallywork.catalog import QUERIES  # noqa: E402

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    if q.sql is None:
        assert q(spark, FOLDER).count() > 0
    else:
        assert differences(q(spark, FOLDER), con, q.sql) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["member_casual", "weekday", "ride_length", "weekday_order"] and df.count() == 21
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_every_operator_has_a_query_and_a_function():
    import importlib

    from inventory import FUNCTIONS, showing

    for operator, names in FUNCTIONS.items():
        assert showing(operator), operator
        if not names.startswith("Spark") and operator != "D11":
            module, first = names.split(",")[0].rsplit(".", 1)
            assert hasattr(importlib.import_module(f"tallywork.{module}"), first), names
