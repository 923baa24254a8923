import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gonggo.session import build_session, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("gonggo-tests", "local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    return session
