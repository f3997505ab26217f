import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pullscan.session import local_session

    s = local_session(4, app="pullscan-tests", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


FILES = "repo string, pr_number bigint, file_ord bigint, filename string, status string, patch string, content string"


@pytest.fixture
def make_files(spark):
    """Rows of (filename, content[, patch]) as a table of changed files of one pull request."""

    def make(*rows):
        data = [("org/a", 1, i, r[0], "modified", r[2] if len(r) > 2 else None, r[1]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, FILES)

    return make
