from __future__ import annotations

import pytest

from assetloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.ui.enabled": "false",
        # Plan tests list the executions of a query; none may be evicted by then.
        "spark.sql.ui.retainedExecutions": "1000000",
        "spark.ui.showConsoleProgress": "false",
    }
    session = build_session("assetloom-tests", "local[4]", conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
