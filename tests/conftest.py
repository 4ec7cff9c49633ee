from __future__ import annotations

import pytest

from lettermill.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return "/root/testdata/sf0.001"
