import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from spoofscope.session import get_session
    s = get_session("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def queries():
    from spoofscope.plans.registry import ORACLES, QUERIES, load_all
    load_all()
    return QUERIES, ORACLES
