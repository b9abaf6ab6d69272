import math
from collections import Counter
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pathlode.operators import anomalies, profile, sketches
from pathlode.sources.tables import scalars, table_nodes
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, 1.5, "a", [1, 2], {"x": True}), (2, None, "b", [], {"x": None}), (3, 2.5, "a", None, None), (4, -1.0, None, [None], {"x": False})]
    return table_nodes(spark.createDataFrame(rows, "i int, f double, s string, l array<int>, o struct<x: boolean>"), record_id=F.col("i")).cache()


def test_typed_flattening(nodes):
    counts = {(r.path, r.type): r["count"] for r in nodes.groupBy("path", "type").count().collect()}
    assert counts["$[*]", "object"] == 4 and counts["$[*].l", "array"] == 3 and counts["$[*].l", "null"] == 1
    assert counts["$[*].l[*]", "integer"] == 2 and counts["$[*].l[*]", "null"] == 1
    assert counts["$[*].o.x", "boolean"] == 2 and counts["$[*].o.x", "null"] == 1
    assert {r.value for r in scalars(nodes).where("path = '$[*].o.x'").collect()} == {"true", "false", "null"}


def test_dominant_type_ties_go_to_the_later_type(spark):
    rows = table_nodes(spark.createDataFrame([(1,), (None,)], "v int"))
    assert profile.path_inventory(rows).where("path = '$[*].v'").first().dominant_type == "integer"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=40))
def test_entropies(spark, values):
    stats = profile.value_statistics(profile.value_frequency(table_nodes(spark.createDataFrame([(v,) for v in values], "v string")))).first()
    spectrum = profile.renyi_spectrum(profile.value_frequency(table_nodes(spark.createDataFrame([(v,) for v in values], "v string")))).first()
    p = [c / len(values) for c in Counter(values).values()]
    h = -sum(x * math.log2(x) for x in p)
    assert stats.entropy == pytest.approx(h, abs=1e-9) and stats.cardinality == len(p)
    assert stats.max_rarity == pytest.approx(-math.log2(min(p)), abs=1e-9)
    assert spectrum.h0 + 1e-9 >= spectrum.h1 >= spectrum.h2 - 1e-9 >= spectrum.h_inf - 2e-9
    assert 0 <= stats.normalized_entropy <= 1


def test_numeric_summary_and_outliers(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 4.0, 100.0]
    rows = table_nodes(spark.createDataFrame([(x,) for x in xs], "v double"))
    r = profile.numeric_summary(rows).first()
    m = median(xs)
    assert (r.median, r.mad) == (m, median(abs(x - m) for x in xs)) and r["count"] == 6
    assert [x.value for x in anomalies.numeric_outliers(rows).collect()] == [100.0]
    flat = table_nodes(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "v double"))
    assert [x.z_mad for x in anomalies.numeric_outliers(flat).collect()] == [float("inf")]
    one = table_nodes(spark.createDataFrame([(5.0,)], "v double"))
    assert anomalies.numeric_outliers(one).count() == 0


def test_benford(spark):
    rows = table_nodes(spark.createDataFrame([(float(10**k * d),) for k in range(-3, 4) for d in (1, 1, 2, 9)] + [(0.0,)], "v double"))
    r = profile.benford(rows).first()
    assert (r.d1, r.d2, r.d9, r["count"]) == (14, 7, 7, 28) and not r.conforms


def test_sketches_are_close_and_merge(spark):
    rows = table_nodes(spark.range(20_000).select((F.col("id") % 5000).alias("k"), (F.col("id") + 1).cast("double").alias("x")))
    half = table_nodes(spark.range(10_000, 20_000).select((F.col("id") % 5000).alias("k"), (F.col("id") + 1).cast("double").alias("x")))
    first = table_nodes(spark.range(10_000).select((F.col("id") % 5000).alias("k"), (F.col("id") + 1).cast("double").alias("x")))
    merged = sketches.read_sketches(sketches.merge_sketches(sketches.path_sketches(half).union(sketches.path_sketches(first))))
    got = {r.path: r for r in merged.collect()}
    assert got["$[*].k"].cardinality == pytest.approx(5000, rel=0.08) and got["$[*].x"].total_count == 20_000
    assert got["$[*].x"].median == pytest.approx(10_000, rel=0.05)
    dd = {(r.path, float(r.q)): r.value for r in sketches.ddsketch(rows).collect()}
    assert dd["$[*].x", 0.5] == pytest.approx(10_000, rel=0.021)


def test_adaptive_statistics_withhold_entropy(spark):
    rows = table_nodes(spark.range(3000).select(F.col("id").alias("many"), (F.col("id") % 3).alias("few")))
    got = {r.path: r for r in sketches.adaptive_statistics(rows, limit=100).collect()}
    assert got["$[*].few"].exact and got["$[*].few"].entropy == pytest.approx(math.log2(3), abs=1e-6)
    assert not got["$[*].many"].exact and got["$[*].many"].entropy is None and got["$[*].many"].entropy_upper_bound > 11
