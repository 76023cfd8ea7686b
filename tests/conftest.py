import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from corpusloom.session import build_session  # noqa: E402
from corpusloom.tables import let_workers_import  # noqa: E402

DATA = os.environ.get("CORPUSLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests")
    let_workers_import(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from corpusloom.tables import Tables

    return Tables(spark, DATA)


@pytest.fixture(scope="session")
def oracle():
    from compare import oracle_connection

    return oracle_connection(DATA)
