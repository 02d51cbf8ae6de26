import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest


@pytest.fixture(scope="session")
def spark():
    from trama.session import build, ship

    s = build(4, 4)
    ship(s)
    yield s
    s.stop()
