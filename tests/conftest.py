import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def compare(spark):
    """Rows of a query against rows of its SQL, columns by name."""
    import math

    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.name.split('.')[0]} as select * from '{glob}'")

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 7)
        return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v

    def run(query, sql):
        df = query(spark, DATA)
        cols = sorted(df.columns)
        got = sorted((tuple(norm(r[x]) for x in cols) for r in df.collect()), key=repr)
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        want = sorted((tuple(norm(dict(zip(names, row))[x]) for x in cols) for row in r.fetchall()), key=repr)
        assert got == want

    return run
