from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from scholion.runtime import session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "4")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not Path(DATA).exists():
        pytest.skip("no test data here")
    return DATA
