"""A local session, the given tables, and the comparison with the SQL twins."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": "/tmp/spark-warehouse-tests", "spark.log.level": "ERROR",
    }
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return DATA


def plain(x):
    if isinstance(x, (list, np.ndarray, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return sorted((k, plain(v)) for k, v in x.items())
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 9)
    return str(x)


def rows_of(df: pd.DataFrame) -> list:
    return sorted(([plain(v) for v in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def sql(text: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(text).df()


@pytest.fixture(scope="session")
def same_rows():
    def check(got, want):
        got, want = (x if isinstance(x, pd.DataFrame) else x.toPandas() for x in (got, want))
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check


@pytest.fixture(scope="session")
def run_sql():
    return sql
