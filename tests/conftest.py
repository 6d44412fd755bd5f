import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    """Rows of a pandas table as comparable text, whole floats as whole numbers."""
    text = lambda v: "null" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())
