import random

from pathlode.llm import decontam


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, draw(rng.choice([1, 3, 5, 6, 9, 20, 33, 64, 90]))) for i in range(60)]
    docs = []
    for d in range(120):
        w = draw(rng.choice([0, 4, 50, 400, 3000]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            item = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    texts = [(i, " ".join(w).upper()) for i, w in items] + [(90, None), (91, " ")]
    shingles = lambda t: decontam.exact_shingles((t or "").lower().encode().split())
    expected = []
    for d, t in docs:
        own = shingles(t)
        for i, q in texts:
            s = shingles(q)
            if s and 100 * len(s & own) >= 75 * len(s):
                expected.append((d, i, len(s & own), len(s)))
    left = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(i, t, "y") for i, t in texts], "item_id long, text string, doc_id string")
    got = decontam.contaminated(left, right).collect()
    assert sorted((r.doc_id, r.item_id, r.n_found, r.n_item) for r in got) == sorted(expected) and expected
    clean = decontam.decontaminate(left, right)
    assert clean.columns == left.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {e[0] for e in expected})


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e f{i} g h i j k") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"a b c d e f{i} g h i j k") for i in range(5)], "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == whole


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, items).count() == 0 and decontam.decontaminate(docs, items).count() == 0


def test_item_ids_of_other_types_and_very_long_documents(spark):
    rng = random.Random(2)
    item = " ".join(f"i{k}" for k in range(34))
    long = " ".join(f"w{rng.randrange(40_000)}" for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " " + item + " " + long), (3, item)], "doc_id long, text string")
    items = spark.createDataFrame([("a", item), (None, item), ("c", "not there at all, is it")], "item_id string, text string")
    got = decontam.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id or "", r.n_found) for r in got) == [(d, i, 30) for d in (2, 3) for i in ("", "a")]
    assert [r.doc_id for r in decontam.decontaminate(docs, items).collect()] == [1]


def test_every_size_partition_finds_what_just_suffices(spark):
    """Items of each size with as many shingles changed as 75 % allows, and with one more."""
    rng = random.Random(9)
    docs, items, expected = [], [], []
    for n in (1, 2, 3, 4, 7, 8, 15, 16, 31, 33, 64, 100, 127, 128, 300):
        words = [f"u{n}x{k}" for k in range(n + 4)]
        items.append((n, " ".join(words)))
        for more in (0, 1):
            # words cut off at the end take one shingle each
            lost = n // 4 + more
            body = [f"z{rng.random()}" for _ in range(50)] + words[: len(words) - lost] + [f"y{rng.random()}"]
            docs.append((n * 10 + more, " ".join(body)))
            if 100 * (n - lost) >= 75 * n and n - lost > 0:
                expected.append((n * 10 + more, n, n - lost))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_found) for r in got) == sorted(expected) and len(expected) == 15
