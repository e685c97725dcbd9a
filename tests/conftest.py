from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from hashtrend.session import build_session

    ckpt = tempfile.mkdtemp(prefix="hashtrend-test-ckpt-")
    s = build_session("local[4]", 4, **{"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
