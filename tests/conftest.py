import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parleyspark.session import build_session

    s = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def oracle():
    """Rows of SQL over the test tables, and rows of a DataFrame in the same form."""
    import glob

    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def same_rows(df, con, sql):
    from collections import Counter

    def plain(v):
        return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v if isinstance(v, int) else str(v)

    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    ours = Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert ours == theirs
