import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from riskweave.runtime import build_session

    s = build_session("tests", cores="4", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    p = "/root/testdata/sf0.001"
    if not os.path.isdir(p):
        pytest.skip("driver tables are not here")
    return p
