import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from arbiter.session import build_session, checkpoint_dir
    s = build_session("local[4]", "arbiter-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g"})
    checkpoint_dir(s)
    yield s
    s.stop()
