import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from doorflux.plans.warehouse import Warehouse  # noqa: E402
from doorflux.session import build_session  # noqa: E402

TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # A zone with clock changes: no result may depend on the session time zone.
    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "doorflux-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.sql.maxMetadataStringLength": 10000,
            "spark.sql.session.timeZone": "America/New_York",
            "spark.sql.warehouse.dir": folder / "warehouse",
            "spark.checkpoint.dir": folder / "scratch",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = TESTDATA / "sf0.001"
    if not path.is_dir():
        pytest.skip(f"no test tables in {path}")
    return str(path)


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list[tuple]:
    return sorted((tuple(row) for row in df.collect()), key=repr)
