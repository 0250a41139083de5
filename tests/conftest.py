import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from delayspark.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="delayspark-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # sets a scratch folder only when the session names none
    yield s


@pytest.fixture()
def tmpdir_shared(spark):
    from delayspark.sources.sinks import scratch_path
    return scratch_path(spark, "tests")
