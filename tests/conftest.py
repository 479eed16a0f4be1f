import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from tesserine.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.driver.memory": "3g"})
    ship_package(session)
    yield session
    session.stop()
