import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("GRAPHLOOM_DRIVER_MEMORY", "2g")


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    return local_session("4", 4)


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
