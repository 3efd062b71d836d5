import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallywork.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__sql__maxMetadataStringLength="2000",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as tuples, sorted (missing first) unless an order column is given."""
    got = [tuple(r) for r in df.collect()]
    return got if order else sorted(got, key=lambda r: [(v is not None, str(v)) for v in r])


def ts(text):
    return datetime.datetime.fromisoformat(text)


def day(text):
    return datetime.date.fromisoformat(text)
