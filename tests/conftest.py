import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from billscope.shared import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "billscope-tests",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__sql__autoBroadcastJoinThreshold="10MB",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
