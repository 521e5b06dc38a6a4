import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from weftline.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = make_session("tests", cores="*", shuffle_partitions=4, spark__sql__shuffle__partitions="4")
    yield s


@pytest.fixture(scope="session")
def data():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(d).exists():
        pytest.skip("the test tables are not here")
    return d
