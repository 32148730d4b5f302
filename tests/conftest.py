import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from tidemark.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("tests", cores=8, partitions=4, memory="4g")
    yield s
    s.stop()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
