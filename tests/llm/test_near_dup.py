import random
import re

import numpy as np
from pathlode.llm import near_dup
from pathlode.llm.shingles import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute_sets(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [brute_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed, bases=12, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 12, 30, 60, 90, 200, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w += [rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))]
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_components_against_brute_force(spark):
    texts = corpus(1)
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "one"), (1005, "ONE"), (1006, "one\u00a0two"), (1004, "one"), (None, "only"), (None, "only"), (1007, "big " * 20_000), (1008, "a b c d"), (1009, "A b\x0bc d")]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, rid string, n_shingles int")
    got = near_dup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_deduplicate_keeps_one_of_each_component(spark):
    rows = list(enumerate(corpus(3, bases=4, copies=10)))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(500, None, None), (500, None, None)], "doc_id long, text string, source string")
    kept = near_dup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)} | {500}) + [500]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.deduplicate(none).count() == 0


def test_sketches_meet_and_estimate_well():
    rng = np.random.default_rng(5)
    missed, errors = 0, []
    for n in (4, 20, 45, 50, 80, 90, 300, 1500):
        for _ in range(40):
            both = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            a = np.unique(np.r_[both, rng.integers(0, 1 << 62, n // 7, dtype=np.uint64)])
            b = np.unique(np.r_[both, rng.integers(0, 1 << 62, n // 7, dtype=np.uint64)])
            x, y = near_dup.sketch(a), near_dup.sketch(b)
            missed += not set(near_dup.band_hashes(x).tolist()) & set(near_dup.band_hashes(y).tolist())
            if n >= 90:
                errors.append(near_dup.estimate(x, y) - len(both) / (2 * len(a) - len(both)))
    assert missed == 0
    assert abs(float(np.mean(errors))) < 0.02 and max(map(abs, errors)) < 0.17


def test_shingles_equal_iff_words_equal():
    assert len(shingle_set("a b c d e f")) == 2
    assert np.array_equal(shingle_set("A b\tc  d e"), shingle_set("a B c d e"))
    assert not np.array_equal(shingle_set("a b c d e"), shingle_set("b a c d e"))
    assert not np.array_equal(shingle_set("\u00c4 b"), shingle_set("\u00e4 b"))


def test_components_of_long_paths(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").union(spark.range(200, 205).selectExpr("id AS a", "200L AS b"))
    got = {r.node: r.label for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in range(200, 205)}
