from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from evidentry.session import local_session
    from evidentry.streaming.ordered import PROVIDER, ROCKSDB

    session = local_session(cores=4, partitions=4, **{PROVIDER: ROCKSDB})
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
