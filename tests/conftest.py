from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

import pytest  # noqa: E402

from densefold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(app="tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
