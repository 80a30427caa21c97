import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edgeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


def rows(df, *columns):
    """Sorted plain tuples of a small result."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
