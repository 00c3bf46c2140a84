from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from compare import spark_session

    from eventide.session import prepare

    session = prepare(spark_session(4))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
