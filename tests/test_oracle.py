"""Every query beside its DuckDB statement on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomframe.queries import ORACLE, QUERIES, flagship

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    assert rows or name in ("filter_any_negative", "rolling_average", "filter_allZero", "filter_allNegative", "filter_allMissing")
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_filters_reach_the_scan(spark):
    plan = flagship(spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45" in plan.split("PushedFilters")[1]
    read = plan.split("ReadSchema")[1]
    assert "l_extendedprice" in read and "l_comment" not in read and "l_shipdate" not in read
