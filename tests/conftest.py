import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sawmill.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="sawmill-test-ckpt-")
    session = build_session("local[4]", app="sawmill-tests", shuffle_partitions=4,
                            extra={"spark.checkpoint.dir": ckpt})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_logs(spark):
    from sawmill.sources.fixtures import logs
    return logs(spark, SF_SMALL)


def bodies(spark, rows):
    """Envelope records from (body_id, text) pairs."""
    from sawmill.schema import BODIES
    return spark.createDataFrame(rows, BODIES)
