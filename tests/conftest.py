import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from storelens.session import build_session, shared_dir

    s = build_session("local[*]", 8, app_name="storelens-tests")
    # Tests only: the session has no shared folder, so install a scratch one.
    shared_dir(s, tempfile.mkdtemp(prefix="storelens-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="storelens-test-")
