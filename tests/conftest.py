import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corvane.session import session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="3g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('checkpoints')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def tree_of(spark, files: dict):
    """Raw files ``path → text``."""
    rows = [(p, t.encode() if isinstance(t, str) else t, len(t)) for p, t in files.items()]
    return spark.createDataFrame(rows, "path string, content binary, size long")
