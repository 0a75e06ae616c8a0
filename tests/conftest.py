import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from loomspan.plans.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4", 4, **{"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def data():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test data")
    return str(path)
