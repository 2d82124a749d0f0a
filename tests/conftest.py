import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def comparable(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(comparable(x) for x in v)
    return repr(v)


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Asserts that a query and its SQL give the same columns and rows."""
    from collections import Counter

    def check(query, sql):
        df = query(spark, sf_dir)
        found = duck.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(found.columns)
        at = [found.columns.index(n) for n in names]
        ours = Counter(tuple(comparable(r[n]) for n in names) for r in df.collect())
        theirs = Counter(tuple(comparable(r[i]) for i in at) for r in found.fetchall())
        assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])

    return check
