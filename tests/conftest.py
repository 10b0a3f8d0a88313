import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keytide.session import session

    base = tmp_path_factory.mktemp("spark")
    out = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.checkpoint.dir": f"file://{base}/shared",
            "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        },
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL
