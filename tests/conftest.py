import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stratum.session import get_spark

    s = get_spark(cpus="*", shuffle_partitions=8, app="stratum-tests")
    yield s
