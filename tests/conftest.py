import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores=4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""

    def of(df):
        return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))

    return of
