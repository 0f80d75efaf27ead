import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sensorgate.session import build_session, prepare


@pytest.fixture(scope="session")
def spark():
    s = prepare(build_session("tests", 8, 8))
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
