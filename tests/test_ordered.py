import math
import random

import numpy as np
from pathlode.operators import ordered
from pyspark.sql import functions as F

VALUES = [0.0, -1.0, 1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, 1.0000000000000002, 0.1, 1e9, 1e9 + 1]


def test_cells_keep_the_order(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "x double").select("x", ordered.cell(F.col("x")).alias("c")).orderBy("x").collect()
    assert [r.c for r in rows] == sorted(r.c for r in rows) and rows[-1].c > rows[-2].c


def test_percentiles_and_sums_are_those_of_a_sort(spark):
    r = random.Random(5)
    rows = [(k, float(v), r.randint(1, 4)) for k in ("a", "b", None) for v in {r.choice((r.gauss(0, 1e4), r.randint(0, 50), 1e9 + r.random())) for _ in range(400)}]
    rows += [("one", 7.0, 1), ("same", 3.0, 9)]
    table = spark.createDataFrame([*rows, ("a", None, 3)], "k string, v double, w long")
    points = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {x.k: x.p for x in ordered.percentiles(table, ("k",), "v", "w", points).collect()}
    sums = {(x.k, x.v): (x.before_w, x.total_w, x.next_v) for x in ordered.running(table, ("k",), "v", ("w",)).collect()}
    assert len(sums) == len(rows) and got.keys() == {k for k, _, _ in rows}
    for key, places in got.items():
        mine = sorted((v, w) for k, v, w in rows if k == key)
        assert np.allclose(places, np.percentile([v for v, w in mine for _ in range(w)], [100 * p for p in points]), rtol=1e-12)
        before, total = 0, sum(w for _, w in mine)
        for i, (v, w) in enumerate(mine):
            assert sums[key, v] == (before, total, mine[i + 1][0] if i + 1 < len(mine) else None)
            before += w


def test_without_keys_and_without_rows(spark):
    table = spark.createDataFrame([(2.0, 1), (4.0, 1)], "v double, w long")
    assert ordered.percentiles(table, (), "v", "w", (0.5,)).first().p == [3.0]
    assert ordered.running(table.where("false"), (), "v", ("w",)).count() == 0
    assert ordered.percentiles(table.where("false").withColumn("k", F.lit(1)), ("k",), "v", "w", (0.5,)).count() == 0
