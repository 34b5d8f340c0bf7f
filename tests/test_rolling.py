"""Moving averages by stretches of the order."""

import duckdb
import numpy as np
import pytest

import loomframe as lf
from loomframe.operators import plotting
from loomframe.operators.plotting import moving_averages, rolling_average


@pytest.mark.parametrize("size", [1, 5, 16, 20, 40])
def test_as_each_window_by_itself(spark, monkeypatch, size):
    monkeypatch.setattr(plotting, "STRETCH", 64)
    n = 333
    x, y = [float(i * 40 % n) for i in range(n)], [None if i % 9 == 0 else float(i % 13) for i in range(n)]
    got = sorted((r["x"], r["y"]) for r in rolling_average(lf.data([list(r) for r in zip(x, y, strict=True)], featureNames=["x", "y"]), "x", "y", size).collect() if r["y"] is not None)
    rows = sorted(zip(x, y, strict=True))
    want = []
    for i in range(size - 1, n):
        part = [b for _, b in rows[i - size + 1 : i + 1] if b is not None]
        if part:
            want.append((np.mean([a for a, _ in rows[i - size + 1 : i + 1]]), np.mean(part)))
    assert np.allclose(got, sorted(want))


def test_halves_are_added_as_by_the_statement():
    v = np.sort(np.round(np.random.default_rng(1).uniform(-999, 9999, 500), 2)).repeat(20)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::DOUBLE[]) AS v, unnest(?::BIGINT[]) AS i", [v.tolist(), list(range(len(v)))])
    want = [r[0] for r in con.execute("SELECT m FROM (SELECT i, avg(v) OVER w AS m, count(*) OVER w AS n FROM t WINDOW w AS (ORDER BY i ROWS 19 PRECEDING)) WHERE n = 20 ORDER BY i").fetchall()]
    assert moving_averages(v, 20).tolist() == want
