import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark():
    from catalogwatch.session import build_session, prepare

    s = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g", spark__ui__showConsoleProgress="false"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()
