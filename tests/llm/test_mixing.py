import math
from collections import Counter, defaultdict

import pytest
import xxhash
from pathlode.llm import mixing
from pyspark.sql import functions as F


def docs(spark, sizes):
    rows, d = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((d, " ".join(["w"] * (1 + d * 7 % 40)), source, "clash"))
            d += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string")


def test_tokens(spark):
    texts = [None, "", " ", "a", " a b ", "\ta\x0bb\x0cc\r\n", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.count_tokens(F.col("t"))).collect()] == [0, 0, 0, 1, 2, 3, 1]


def test_repetition_limit_and_budget(spark):
    table = docs(spark, {"big": 1600, "mid": 400, "low": 100})
    out = mixing.mixture(table, max_repeats=2.0).collect()
    tokens, once = Counter(), Counter()
    for r in out:
        tokens[r.source] += r.tokens
        if r.epoch == 1:
            once[r.source] += r.tokens
    shares = {s: once[s] / sum(once.values()) for s in once}
    e = out[0].exponent
    assert (max(shares.values()) / min(shares.values())) ** (1 - e) == pytest.approx(2.0, rel=1e-6)
    total = sum(tokens.values())
    for r in out:
        assert tokens[r.source] / total == pytest.approx(r.weight, rel=0.03)
    assert len({r.doc_id for r in out}) == 2100 and max(r.copies for r in out) == 2


def test_target_entropy(spark):
    table = docs(spark, {"big": 900, "mid": 300, "low": 50})
    weights = {r.source: r.weight for r in mixing.mixture(table, target_entropy=0.9, max_repeats=None).collect()}
    assert -sum(w * math.log(w) for w in weights.values()) == pytest.approx(0.9, abs=1e-6)


def test_blocks_hold_every_source(spark):
    out = mixing.mixture(docs(spark, {"a": 4000, "b": 1000})).collect()
    by_block = Counter((r.block, r.source) for r in out)
    assert {b for b, _ in by_block} == set(range(mixing.BLOCKS))
    assert all(by_block[b, s] > 0 for b in range(mixing.BLOCKS) for s in "ab")


def test_documents_follow_the_plan_and_keep_columns(spark):
    table = docs(spark, {"a": 300, None: 60, "b": 30})
    planned = Counter(r.doc_id for r in mixing.mixture(table).collect())
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    assert Counter(r.doc_id for r in mixed.collect()) == planned and len(planned) == 390


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x y", None), (2, "", ""), (3, "long " * 50_000, "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(table).collect()
    assert len(got) >= 5 and {r.doc_id for r in got} == {1, 2, 3, None}
    assert mixing.mix_documents(table.limit(0)).count() == 0
    assert mixing.mixture(table.where("text = ''")).count() == 1


def spark_hash(*values):
    """xxhash64 of ints (4 bytes), longs (tuples of one) and texts; nulls leave the seed as it is."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(4, "little") if isinstance(v, int) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.encode(), h)
    return h


def brute(rows, exponent_of, seed=7):
    """(doc_id, epoch, copies, block, place_in_block) of each row of the mixture, and the weights, in plain Python."""
    tokens, by_source = defaultdict(int), defaultdict(list)
    for rid, (d, t, s) in rows:
        n = len((t or "").split())
        tokens[s] += n
        by_source[s].append((spark_hash(seed, None if d is None else (d,), t) >> 1, n, rid, d))
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n}
    a = exponent_of(shares)
    z = sum(p**a for p in shares.values())
    out, weights = [], {s: p**a / z for s, p in shares.items()}
    for s, own in by_source.items():
        epochs = max(1.0, (max(shares.values()) / shares[s]) ** (1 - a)) if s in shares else 1.0
        whole, reached, last = math.floor(epochs + 1e-9), 0, -1
        goal = max(0.0, epochs - whole) * tokens[s]
        for place in sorted({p for p, *_ in own}):
            reached += sum(n for p, n, *_ in own if p == place)
            if goal > 0 and reached <= goal:
                last = place
            elif goal > 0:  # the hash range in which the goal lies is begun
                last = max(last, ((place >> 51) << 51) - 1)
                break
        for place, n, rid, d in own:
            copies = whole + (place <= last)
            for e in range(1, copies + 1):
                part = (spark_hash((place,), e) >> 1) / 2.0**63
                at = e - 1 + part if e <= whole else whole + (epochs - whole) * place / (last + 1.0)
                if s not in shares:
                    at, epochs = part, 1.0
                turn = spark_hash((place,), e, (rid,)) >> 1
                out.append([min(63, math.floor(64 * at / epochs)), turn, d is None, d or 0, rid, e, copies])
    seen = Counter()
    got = []
    for block, _, none, d, _, e, copies in sorted(out):
        got.append((None if none else d, e, copies, block, seen[block]))
        seen[block] += 1
    return got, weights


def fixture():
    rows = []
    for d in range(900):
        source = ["big"] * 6 + ["mid"] * 2 + ["low", None]
        rows.append((d, "w " * (1 + d * 7 % 40) + str(d), source[d % 10]))
    return rows + [(None, None, "empty"), (None, "", "empty"), (5, "again", "low"), (5, "again", "low"), (901, None, "big")]


@pytest.mark.parametrize("goal", [{"max_repeats": 2.0}, {"max_repeats": 1.3}, {"max_repeats": None, "target_entropy": 1.2}])
def test_against_brute_force(spark, goal):
    rows = fixture()
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, block string").coalesce(1)

    def exponent(shares):
        if goal["max_repeats"]:
            return max(0.0, 1 - math.log(goal["max_repeats"]) / math.log(max(shares.values()) / min(shares.values())))
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            z = sum(p**mid for p in shares.values())
            entropy = -sum(p**mid / z * math.log(p**mid / z) for p in shares.values())
            low, high = (low, mid) if entropy <= 1.2 else (mid, high)
        return high

    want, weights = brute(list(enumerate(rows)), exponent)
    got = mixing.mixture(table, **goal).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.epoch, r.copies, r.block, r.place_in_block) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        if r.source != "empty":
            assert r.weight == pytest.approx(weights[r.source], rel=1e-9)
    # the documents come in this order
    order = [d for d, _, _, block, place in sorted(want, key=lambda r: (r[3], r[4]))]
    assert [r.doc_id for r in mixing.mix_documents(table, **goal).collect()] == order


def test_very_many_sources(spark):
    table = spark.range(60_000).selectExpr("id AS doc_id", "'some words here' AS text", "if(id % 3 = 0, 'hot', concat('host', id)) AS source")
    got = mixing.mixture(table, target_entropy=9.0, max_repeats=None).groupBy("source").agg(F.max("weight").alias("w"), F.count("*").alias("c"))
    total = got.agg(F.sum("w"), F.sum(-F.col("w") * F.log("w")), F.count("*")).first()
    assert total[0] == pytest.approx(1.0, rel=1e-6) and total[1] == pytest.approx(9.0, rel=1e-6) and total[2] == 40_001
