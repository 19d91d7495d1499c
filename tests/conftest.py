import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("CORPUSKIT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corpuskit.session import build_session, checkpoint_dir
    s = build_session("local[4]", shuffle_partitions=8, extra={"spark.ui.enabled": "false"})
    # tests only: no shared folder is configured locally, so make one for this run
    checkpoint_dir(s, tempfile.mkdtemp(prefix="ck-test-"))
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
