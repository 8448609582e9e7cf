import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siftline.session import build_session

    base = tmp_path_factory.mktemp("spark")
    session = build_session("local[4]", shuffle_partitions=4, spark__sql__warehouse__dir=str(base / "warehouse"), spark__checkpoint__dir=str(base / "shared"), spark__driver__memory="4g")
    yield session
    session.stop()
