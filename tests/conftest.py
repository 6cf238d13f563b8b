import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import local_session, ship_package

    s = local_session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield ship_package(s)
    s.stop()
