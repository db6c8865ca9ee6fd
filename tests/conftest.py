import os
import sys

import duckdb
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plumbline.session import session

    shared = tmp_path_factory.mktemp("shared")
    os.environ["PYTHONPATH"] = os.pathsep.join([REPO, os.environ.get("PYTHONPATH", "")])
    s = session(
        "tests",
        spark__master="local[8]",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(shared / "checkpoints"),
        spark__sql__warehouse__dir=str(shared / "warehouse"),
        spark__local__dir=str(shared / "local"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(f"{float(value):.9g}")
    if hasattr(value, "as_tuple"):
        return float(f"{float(value):.9g}")
    return str(value)


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    """Holds a Spark result against SQL: columns, and rows in any order."""

    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(([_cell(v) for v in row] for row in df.select(*names).collect()), key=repr)
        cursor = duck.execute(sql)
        there = [d[0] for d in cursor.description]
        assert sorted(there) == names
        wanted = sorted(([_cell(row[there.index(n)]) for n in names] for row in cursor.fetchall()), key=repr)
        assert got == wanted

    return check
