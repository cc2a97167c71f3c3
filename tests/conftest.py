import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = ":".join(filter(None, (str(ROOT), os.environ.get("PYTHONPATH"))))

from docmetrics.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    session = get_session("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
