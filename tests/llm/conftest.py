import pytest


@pytest.fixture(autouse=True, scope="session")
def shared(spark, tmp_path_factory):
    """A shared folder that goes with the test run, where the session names none."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
