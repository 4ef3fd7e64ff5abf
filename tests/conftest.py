"""One session for all tests, and the tables by scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from fernweft.session import get_session
from fernweft.tables import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cpus=8, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": 4})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con
