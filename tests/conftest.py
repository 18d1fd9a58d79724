import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from registra.session import clear_work, local_session, ship_package

    ship_package()
    session = local_session(8, "tests", tmp_path_factory.mktemp("shared").as_uri())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_work(session)
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over a single made-up row."""

    def run(expr, **columns):
        names = list(columns)
        frame = spark.sql("SELECT " + ", ".join(f"{columns[n]} AS {n}" for n in names) if names
                          else "SELECT 1 AS unused")
        return frame.select(expr.alias("out")).first()["out"]

    return run
