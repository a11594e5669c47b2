import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from brindle.session import get_spark

    s = get_spark("tests", cores=4, shuffle=4)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")
