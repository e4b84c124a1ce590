import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__  # noqa: E402,F401
from bench import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("8")
