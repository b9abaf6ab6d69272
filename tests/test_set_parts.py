"""Similar sets found in parts of the items."""

import random

import numpy as np
import pytest

from pathlode.operators import fingerprints, set_parts
from tests.test_operators import _brute_clusters


def _jaccard(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [1, 7, 60, 1 << 20])
@pytest.mark.parametrize("least", [0.29, 0.5, 0.8])
def test_similar_pairs_against_brute_force(monkeypatch, block, least):
    monkeypatch.setattr(set_parts, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(20):
        sets = [set(rng.choices(range(25), k=rng.randrange(1, 16))) for _ in range(25)]
        skip = rng.randrange(25)
        items = [i for s in sets for i in rng.sample(sorted(s), len(s))]
        a, b = set_parts.similar_pairs(np.array([len(s) for s in sets]), np.array(items), skip, least)
        want = [(x, y) for x in range(skip, 25) for y in range(x) if _jaccard(sets[x], sets[y]) > least]
        # a pair at the threshold may come too: it is left to the confirmation
        got = [p for p in zip(a.tolist(), b.tolist(), strict=True) if abs(_jaccard(sets[p[0]], sets[p[1]]) - least) > 1e-6]
        assert sorted(got) == [p for p in want if abs(_jaccard(sets[p[0]], sets[p[1]]) - least) > 1e-6]
        assert set(want) <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_colliding_hashes_lose_no_pair():
    """Items that share a hash stand twice in a set."""
    rng = random.Random(2)
    for _ in range(200):
        sets = [set(rng.choices(range(30), k=rng.randrange(1, 12))) for _ in range(15)]
        a, b = set_parts.similar_pairs(np.array([len(s) for s in sets]), np.array([i % 20 for s in sets for i in s]), 0, 0.5)
        assert {(x, y) for x in range(15) for y in range(x) if _jaccard(sets[x], sets[y]) > 0.5} <= set(zip(a.tolist(), b.tolist(), strict=True))


def _near(rng, base, share):
    """A set of the size of ``base`` that is about ``share`` similar to it."""
    kept = rng.sample(base, round(2 * share / (1 + share) * len(base)))
    return set(kept) | {rng.randrange(10**6, 10**9) for _ in range(len(base) - len(kept))}


@pytest.mark.parametrize("text", [False, True])
def test_links_of_long_sets_against_brute_force(spark, monkeypatch, text):
    """Sizes on both sides of LONG and of the powers of two, similarities about the threshold, subsets and equal sets."""
    monkeypatch.setattr(fingerprints, "PART_ITEMS", 300)
    rng = random.Random(5)
    sets = {}
    for size in (30, 60, 64, 70, 100, 127, 128, 130, 200, 256, 400):
        for share in (0.48, 0.495, 0.505, 0.52, 0.7):
            base = rng.sample(range(2000), size)
            for s in (set(base), _near(rng, base, share), set(base[: int(share * size) + 1]), set(base)):
                sets[f"d{len(sets)}" if text else len(sets)] = {f"i{x}" for x in s} if text else s
    rows = spark.createDataFrame([(d, i) for d, s in sets.items() for i in s], "d string, i string" if text else "d long, i long")
    got = {r.d: r.cluster for r in fingerprints.clusters(rows, "d", fingerprints.similar_links(rows, "d", "i")).collect()}
    want = _brute_clusters(sets)
    assert got == want and 55 < len(set(want.values())) < 165


def _shuffled_rows(spark):
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_that_only_share_items_are_not_shuffled(spark):
    """Each item is in about 20 of 300 sets, so nearly all sets share a rare one; shuffling such pairs filled the disk."""
    rng = random.Random(9)
    sets = {d: set(rng.sample(range(1500), 100)) for d in range(300)}
    sets[300] = _near(rng, sorted(sets[7]), 0.6)
    rows = spark.createDataFrame([(d, i) for d, s in sets.items() for i in s], "d long, i long")
    before = _shuffled_rows(spark)
    links = fingerprints.similar_links(rows, "d", "i").collect()
    assert sorted((r.a, r.b) for r in links) in ([(7, 300)], [(300, 7)])
    assert _shuffled_rows(spark) - before < len(sets) * 100


def test_near_copies_are_not_all_confirmed(spark, monkeypatch):
    """A group of near copies, two of its members that are like each other but unlike its smallest, and a chain."""
    rng = random.Random(4)
    base = rng.sample(range(1000), 100)
    sets = {d: _near(rng, base, 0.9) for d in range(40)}
    sets[40] = set(base[:60]) | set(range(2000, 2040))
    sets[41] = set(base[:60]) | set(range(2000, 2030)) | set(range(3000, 3010))
    for d in range(50, 55):
        sets[d] = set(range(5000 + 30 * d, 5100 + 30 * d))
    asked = []
    confirmed = fingerprints._confirmed
    monkeypatch.setattr(fingerprints, "_confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirmed(pairs, *rest))
    rows = spark.createDataFrame([(d, i) for d, s in sets.items() for i in s], "d long, i long")
    got = {r.d: r.cluster for r in fingerprints.clusters(rows, "d", fingerprints.similar_links(rows, "d", "i")).collect()}
    assert got == _brute_clusters(sets) and got[41] == 40 and got[54] == 50
    assert sum(asked) < 3 * len(sets)
