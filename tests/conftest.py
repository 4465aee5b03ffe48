from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from storelens.session import single_machine_session

    session = single_machine_session(8, **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
