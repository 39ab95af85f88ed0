import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillon.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                          spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
                          spark__driver__extraJavaOptions=f"-Dderby.system.home={tmp_path_factory.mktemp('derby')}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as plain tuples in the order of the given columns (default: all)."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
