"""Results equal SQL's to the last digit, where rounding would make a difference of it."""

import random

import duckdb
import pandas as pd

from sitegrid import functions as fn

FISHER = """SELECT i, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, least(1.0, sum(CASE WHEN lp <= lobs + ln(1+1e-7) THEN exp(lp) ELSE 0 END)) AS p FROM (
    SELECT *, lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(k+1)-lgamma(a+b-k+1)-lgamma(a+c-k+1)-lgamma(d-a+k+1) AS lp,
      lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(a+1)-lgamma(b+1)-lgamma(c+1)-lgamma(d+1) AS lobs FROM (
      SELECT *, unnest(range(greatest(0,a-d), least(a+b,a+c)+1)) AS k FROM tables)) GROUP BY i ORDER BY i"""


def test_fisher_equals_the_formula_in_sql():
    rng = random.Random(3)
    tables = pd.DataFrame([(i, *(rng.randrange(n) for n in (30, 200, 300, 900))) for i in range(2000)], columns=list("iabcd"))  # noqa: F841
    want = duckdb.sql(FISHER).df()
    got = fn.fisher_exact(want.a, want.b, want.c, want.d)
    assert got.tolist() == want.p.tolist()


def test_rounded_as_sql_does(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(1000)] + [k / 2000 + e for k in range(-500, 500) for e in (0, 1e-17, 6e-17)] + [0.49999999999999994, 1e300, float("inf"), -0.0005, None]
    rows = pd.DataFrame({"i": range(len(values)), "x": values})
    for n in (0, 3, 9):
        want = [r[0] for r in duckdb.sql(f"SELECT round(x, {n}) FROM rows ORDER BY i").fetchall()]
        got = [r.y for r in spark.createDataFrame(list(enumerate(values)), "i long, x double").select("i", fn.rounded(fn.F.col("x"), n).alias("y")).orderBy("i").collect()]
        assert [x if x is None or x == x else None for x in got] == [x if x is None or x == x else None for x in want]
