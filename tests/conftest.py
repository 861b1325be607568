import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigilframe.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "vigilframe-tests", spark__checkpoint__dir=tempfile.mkdtemp(prefix="vigilframe-test-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from vigilframe.plans.registry import Tables

    return Tables(spark, SF)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="vigilframe-io-")
