import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from regstat.session import get_session
    scratch = tempfile.mkdtemp(prefix="regstat-test-")
    s = get_session("local[4]", 4, app_name="regstat-tests",
                    extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    s.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    yield s
    s.stop()


@pytest.fixture
def scratch_dir():
    return tempfile.mkdtemp(prefix="regstat-t-")


SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
