import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from chirpflow.session import build_session, ensure_checkpoint_dir

    s = build_session("local[4]", app="chirpflow-tests", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="chirpflow-test-")
