import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # The shared folder comes from spark.checkpoint.dir when the environment names one;
    # quire.session.shared_dir falls back to a private folder only when it is unset.
    session = build_session("local[4]", 4, "quire-tests")
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    from quire.session import shared_dir

    return tempfile.mkdtemp(dir=shared_dir(spark))
