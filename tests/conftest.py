import os
import sys

import pytest

os.environ.setdefault("PAVEMENT_SHUFFLE", "3")  # the test frames are small
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from pavement.session import local_session

    session = local_session("4", "tests")
    yield session
    session.stop()
