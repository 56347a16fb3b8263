import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same(duck):
    """Checks a DataFrame against DuckDB SQL: columns, and rows as a multiset."""

    def check(df, sql):
        mine = df.collect()
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        theirs = cursor.fetchall()
        assert sorted(df.columns) == sorted(names)
        columns = sorted(names)
        left = sorted([[plain(r[c]) for c in columns] for r in mine], key=str)
        right = sorted([[plain(r[names.index(c)]) for c in columns] for r in theirs], key=str)
        assert left == right

    return check
