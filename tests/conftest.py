import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lumberline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "lumberline-tests", partitions=2)
    session.sparkContext.setLogLevel("ERROR")
    # Compiling code for a handful of rows takes most of the time of a test; the queries checked
    # against SQL run with it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    """A table ``(file_path, block, seq, text)`` from lists of lines, cut into small blocks."""

    def make(block: int = 1 << 20, **files: list[str]):
        rows = [(name, i // block, i, text) for name, texts in files.items() for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "file_path string, block bigint, seq bigint, text string")

    return make
