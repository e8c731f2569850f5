import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from commentlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows_of():
    """Sorted tuples of a DataFrame."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
