import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wakeline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]",
        **{"spark.sql.shuffle.partitions": "2",
           # tiny inputs: compiling stages would take most of the time
           "spark.sql.codegen.wholeStage": "false", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(ddl, (..), (..)) -> DataFrame."""
    return lambda ddl, *data: spark.createDataFrame(list(data), ddl)
