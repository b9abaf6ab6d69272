import heapq
import zlib
from collections import defaultdict

import xxhash
from pathlode.llm import sharding


def table(spark):
    rows = [(i, "t" * (i * 37 % 500), "clash") for i in range(3000)] + [(None, None, None), (None, None, None), (5, "é☃", "x"), (7, "", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_bytes_law_slots_and_digests(spark):
    got = sharding.assign_shards(table(spark)).collect()
    loads, slots = defaultdict(int), defaultdict(list)
    for r in got:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 3004 and set(loads) == set(range(16))
    assert max(loads.values()) - min(loads.values()) <= 1000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {(r.doc_id, r["size"], r.text_crc32) for r in got}
    assert (5, len("é☃".encode()) + 1, zlib.crc32("é☃".encode())) in sizes and (None, 1, 0) in sizes and (7, 1, 0) in sizes
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.virtual_slot)
    assert all(len(v) == 1 for v in by_id.values())


def test_maps_are_edited_not_dealt_anew():
    sizes = [(k * 7919) % 1000 + 1 for k in range(4096)]
    first = sharding.first_map(sizes)
    assert max(first.loads(sizes)) - min(first.loads(sizes)) <= max(sizes)
    grown = sharding.rebalance(first, sizes, 17)
    assert grown.version == 2 and max(grown.loads(sizes)) - min(grown.loads(sizes)) <= max(sizes)
    moved = [k for k in range(4096) if first.shard_of[k] != grown.shard_of[k]]
    assert len(moved) < 4096 / 8 and sum(grown.shard_of[k] == 16 for k in moved) > 0.5 * len(moved)
    shrunk = sharding.rebalance(grown, sizes, 15)
    assert set(shrunk.shard_of) == set(range(15))
    assert all(shrunk.shard_of[k] == grown.shard_of[k] for k in range(4096) if grown.shard_of[k] < 15)


def test_map_versions_are_stored(spark, tmp_path):
    first = sharding.first_map([1, 2, 3, 4], 2)
    second = sharding.rebalance(first, [9, 2, 3, 4], 2)
    for m in (first, second):
        sharding.save_map(spark, m, str(tmp_path / "maps"))
    assert sharding.load_map(spark, str(tmp_path / "maps")) == second
    assert sharding.load_map(spark, str(tmp_path / "maps"), 1) == first


def test_documents_get_the_same_shards(spark):
    docs = table(spark)
    a = {(r.doc_id, r.virtual_slot): r.shard for r in sharding.assign_shards(docs).collect()}
    out = sharding.shard_documents(docs)
    assert set(out.columns) == {"doc_id", "text", "shard", "virtual_slot"}
    assert all(a[r.doc_id, r.virtual_slot] == r.shard for r in out.collect())
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_a_later_run_edits_the_stored_map(spark, tmp_path):
    maps = str(tmp_path / "maps")
    docs = table(spark)
    sharding.assign_shards(docs, maps=maps).count()
    first = sharding.load_map(spark, maps)
    sharding.shard_documents(docs, maps=maps).count()
    assert first.version == 1 and sharding.load_map(spark, maps) == first
    more = docs.union(spark.createDataFrame([(9000 + k, "t" * 2000, "x") for k in range(40)], docs.schema))
    got = {(r.virtual_slot, r.shard, r.map_version) for r in sharding.assign_shards(more, maps=maps).collect()}
    second = sharding.load_map(spark, maps)
    assert {v for _, _, v in got} == {second.version} and all(second.shard_of[k] == s for k, s, _ in got)
    assert sum(a != b for a, b in zip(first.shard_of, second.shard_of, strict=True)) < 200


def test_every_run_stores_its_map(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "scratch_root", lambda _: str(tmp_path))
    for k, run in enumerate((sharding.assign_shards, sharding.shard_documents), 1):
        run(table(spark)).count()
        assert len(list(tmp_path.glob("slot-maps-*"))) == k


def test_against_brute_force(spark):
    """Sizes, digests, slots, the map and the shards, all computed anew in plain Python."""
    rows = [(i, "é☃ text " * (i * 13 % 90)) for i in range(2500)] + [(None, None), (None, "no id"), (7, ""), (8, "x" * 300_000), (9, "x" * 300_000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def slot(i, t):
        if i is not None:
            h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        else:
            h = xxhash.xxh64_intdigest(b"no id", 42)
            h = h if t is None else xxhash.xxh64_intdigest(t.encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS

    sizes = [0] * sharding.SLOTS
    for i, t in rows:
        sizes[slot(i, t)] += len((t or "").encode()) + 1
    heap, shard_of = [(0, 0, s) for s in range(16)], {}
    for k in sorted(range(sharding.SLOTS), key=lambda k: (-sizes[k], k)):
        load, held, s = heapq.heappop(heap)
        shard_of[k] = s
        heapq.heappush(heap, (load + sizes[k], held + 1, s))
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", slot(i, t), shard_of[slot(i, t)]) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.law, r.virtual_slot, r.shard) for r in got) == want


def test_shrinking_moves_only_what_it_has_to():
    for seed in range(5):
        sizes = [(k * 7919 + seed * 31) % 1000 + 1 for k in range(4096)]
        first = sharding.rebalance(sharding.first_map(sizes, 16), sizes, 17)
        less = sharding.rebalance(first, sizes, 15)
        moved = [k for k in range(4096) if less.shard_of[k] != first.shard_of[k] and first.shard_of[k] < 15]
        assert moved == [] and max(less.loads(sizes)) - min(less.loads(sizes)) <= max(sizes)
        assert sharding.rebalance(less, sizes, 15).shard_of == less.shard_of
