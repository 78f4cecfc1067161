import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gristmill.session import session

    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def store(spark, tmp_path_factory):
    from gristmill.sources.store import build_store, open_store

    path = str(tmp_path_factory.mktemp("data") / "store")
    build_store(spark, path)
    open_store(spark, path)
    return path
