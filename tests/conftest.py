import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import os

os.environ["PYTHONPATH"] = f"{Path(__file__).parents[1]}:{os.environ.get('PYTHONPATH', '')}"

from sparkloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("2", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
