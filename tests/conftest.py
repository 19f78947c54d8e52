import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stocksmith.session import get_spark
    # a tiny hot-key threshold sends almost every key through the chunked
    # (skew) path, so the oracle tests check that path too
    s = get_spark("local[4]", app="stocksmith-tests", shuffle_partitions=8,
                  extra={"stocksmith.hotKeyRows": "5"})
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from stocksmith.sources.fixtures import Tables
    return Tables(spark, SF_SMALL)
