import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lakeweave.session import build_session

    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "lakeweave-tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={
            "spark.checkpoint.dir": str(base / "checkpoints"),
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "2000",
        },
    )
    yield session
    session.stop()
