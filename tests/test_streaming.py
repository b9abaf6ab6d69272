from pathlode.operators.fingerprints import shape_fingerprints
from pathlode.operators.sketches import merge_sketches, path_sketches, read_sketches, sketch_bytes
from pathlode.sources.tables import table_nodes
from pathlode.streaming import statistics
from pyspark.sql import functions as F


def test_streaming_equals_batch(spark, tmp_path):
    table = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("x"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = statistics.start_statistics(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    running.processAllAvailable()
    running.stop()
    got = {r.path: r for r in statistics.read_statistics(spark, str(tmp_path / "state")).collect()}
    want = {r.path: r for r in read_sketches(path_sketches(table_nodes(table))).collect()}
    for path, r in want.items():
        assert (got[path].total_count, got[path].cardinality, got[path].min, got[path].max, got[path].mean) == (r.total_count, r.cardinality, r.min, r.max, r.mean)
    statistics.compact_statistics(spark, str(tmp_path / "state"), str(tmp_path / "compact"))
    assert statistics.read_statistics(spark, str(tmp_path / "compact")).count() == len(want)


def test_windows_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2021-01-01 00:00:00"), ("a", "2021-01-01 00:10:00"), ("a", "2021-01-02 12:00:00"), ("b", "2021-01-05 00:00:00")], "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, build in (("w", lambda s: statistics.windowed_counts(s, "t", "k")), ("s", lambda s: statistics.sessions(s, "t", "k"))):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        running = build(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
        running.processAllAvailable()
        running.stop()
        assert {(r.k, r.n) for r in spark.table(name).collect()} >= {("a", 2), ("a", 1)}


def test_fingerprint_of_a_stream(spark, tmp_path):
    table = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.col("id").cast("double").alias("x"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = statistics.start_fingerprint(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    running.processAllAvailable()
    running.stop()
    want = shape_fingerprints(table_nodes(table, record_id=F.lit(1))).select("nodes", "path_set", "typed_path").collect()
    assert statistics.read_fingerprint(spark, str(tmp_path / "state")).collect() == want


def test_sketch_bytes_do_not_grow_with_the_table(spark):
    def most(n):
        rows = sketch_bytes(merge_sketches(path_sketches(table_nodes(spark.range(n).select(F.col("id").cast("string").alias("x")))))).collect()
        return max(r.hll_bytes for r in rows)

    assert most(20000) == most(200000) < 3000
