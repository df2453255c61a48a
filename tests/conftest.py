import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from innsight.session import build_session
    scratch = tempfile.mkdtemp(prefix="innsight-test-")
    s = build_session("local[*]", app_name="innsight-tests", shuffle_partitions=8, conf={
        "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
        "spark.driver.extraJavaOptions": f"-Dderby.system.home={scratch}",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="innsight-run-")


def rows(df):
    return [tuple(r) for r in df.collect()]
