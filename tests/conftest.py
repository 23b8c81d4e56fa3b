import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from equiscan.session import build_session

    session = build_session("local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def desk(spark):
    if not Path(SMALL).exists():
        pytest.skip("test data is not here")
    from equiscan.checks.desk import Desk

    return Desk(spark, SMALL)


@pytest.fixture()
def database(spark, tmp_path):
    from equiscan.sinks.tables import create_database

    name = f"t_{abs(hash(str(tmp_path))) % 10**9}"
    create_database(spark, name, str(tmp_path / "db"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")
