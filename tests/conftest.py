import pytest

from sievegrid.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "sievegrid-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": shared,
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
