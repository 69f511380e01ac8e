"""Every query against its SQL on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from codeplane.plans import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if v is None:
        return ""
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "" if math.isnan(v) else f"{float(v):.4f}".rstrip("0").rstrip(".")
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLE:
        return
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert rows == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())
