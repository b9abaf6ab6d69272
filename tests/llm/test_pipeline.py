import random
from pathlib import Path

import corpus_pipeline
import pytest
import xxhash
from pathlode.llm import common, mixing, near_dup, quality, sharding
from pathlode.llm.common import collected_scratch, drop_scratch, materialize, scratch_root, spread_join
from pyspark.sql import functions as F

from tests.llm.test_near_dup import brute
from tests.llm.test_near_dup import words as split_words


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [a + b + c for a in ("ab", "cor", "den", "fil", "gra") for b in ("a", "e", "i", "o") for c in ("lis", "mor", "net", "pur", "sta", "ven")]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 120), f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, rows[i][1] + " tail", "s0") for i in range(5)]
    rows += [(200, prose(rng, 80) + " " + item + " " + prose(rng, 20), "s1"), (201, "too short", "s1"), (202, None, None), (203, "SHOUT!! " * 80, "s2")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) < set(got.columns)
    found = {r.doc_id for r in got.collect()}
    good = [(d, t) for d, t, _ in rows if len(split_words(t)) >= 50 and "SHOUT" not in t]
    kept = {c for _, _, c in brute(good)} - {200}
    assert found == kept
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    # how often a document is read, and where it goes, computed from what is left
    left = spark.createDataFrame([(d, t, s) for d, t, s in rows if d in kept], "doc_id long, text string, source string")
    assert counts == {r.doc_id: r.copies for r in mixing.mixture(left).where("epoch = 1").collect()}
    placed = {(r.doc_id, r.virtual_slot, r.shard) for r in got.collect()}
    texts = {d: t for d, t, _ in rows}
    sizes = [0] * sharding.SLOTS
    for d, slot, _ in placed:
        h = xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42)
        assert slot == (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS
        sizes[slot] += counts[d] * (len(texts[d].encode()) + 1)
    assert all(sharding.first_map(sizes).shard_of[slot] == shard for _, slot, shard in placed)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    none.select(F.col("doc_id").alias("item_id"), "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == none.columns


def test_stages_call_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "mix_sources", "shard"]
    assert all(map(callable, (quality.filter_quality, near_dup.deduplicate, mixing.mix_documents)))


def test_scratch_tables_are_written_whole(spark):
    root = scratch_root(spark)
    table = materialize(spark.range(10).withColumn("r", F.monotonically_increasing_id()), "t")
    assert table.count() == 10 and root


def test_scratch_goes_when_told(spark):
    with collected_scratch() as tables:
        materialize(spark.range(3), "t")
        with collected_scratch() as inner:
            materialize(spark.range(3), "t")
    paths = [p.removeprefix("file://") for _, p in tables + inner]
    assert len(tables) == len(inner) == 1 and all(Path(p).exists() for p in paths)
    drop_scratch(tables + inner)
    assert not any(Path(p).exists() for p in paths)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"
        applicationId = "app"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Elsewhere()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            scratch_root(Session())


def test_spread_join_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.range(1000).selectExpr("if(id % 2 = 0, 'hot', if(id % 7 = 0, null, concat('k', id % 97))) AS k", "id % 3 AS `odd.name`", "id")
    lookup = materialize(rows.where("k is not null and k <> 'k5'").groupBy("k").count().withColumn("v", F.length("k")), "lookup")
    for how in ("inner", "left"):
        got = spread_join(rows, lookup, ["k"], "count", how)
        want = rows.join(lookup, "k", how).select(*got.columns[:1], "`odd.name`", "id", "count", "v")
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert spread_join(rows, lookup.limit(0), ["k"], "count", "left").count() == 1000
