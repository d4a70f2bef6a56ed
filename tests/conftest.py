import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tickloom.session import local_session

    return local_session("tests", cpus=os.environ.get("TEST_CPUS", "8"), memory="8g", shared=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def sf():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("sample tables are not available")
    return path
