import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from listwatch.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app_name="listwatch-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="listwatch-test-ckpt-"),
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples (optionally a column subset)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
