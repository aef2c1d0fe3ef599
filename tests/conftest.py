import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    out = session("tests", "local[4]", **{"spark__ui__enabled": "false", "spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false"})
    out.sparkContext.setLogLevel("ERROR")
    return out
