import sys
from pathlib import Path

import pytest
from pyspark import SparkContext, StatusTracker
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def own_job_groups(monkeypatch, request):
    """Job groups of different tests are different ones, whatever their names."""
    set_group, ids = SparkContext.setJobGroup, StatusTracker.getJobIdsForGroup
    monkeypatch.setattr(SparkContext, "setJobGroup", lambda self, group, *rest: set_group(self, f"{request.node.nodeid}/{group}", *rest))
    monkeypatch.setattr(StatusTracker, "getJobIdsForGroup", lambda self, group: ids(self, f"{request.node.nodeid}/{group}"))
