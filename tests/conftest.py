import pytest

from tickerloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    found = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.checkpoint.dir": str(shared)})
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
