import math
import re
import unicodedata
from collections import Counter

from pathlode.llm import quality
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    counts, covered = Counter(windows), set()
    for i, g in enumerate(windows):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a", "x y z w x y z q x y z", "l\nl\n l\nl\n\n\n", "é # * $ % & | < > ü", "a\u00a0b c\x1fd", "p q r s t " * 400, "one two three four " + "z" * 100_000]


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for r in quality.quality_report(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.quality_report(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed")
    r = judged.agg(F.avg(F.when(F.col("label") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("label") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r.good > 0.97 and r.bad < 0.1


def test_label_model_learns_accuracies():
    good, bad = (1, 1, 1, 0, 0), (1, 0, 0, -1, -1)
    model = quality.fit_label_model([(good, 800), (bad, 150), ((1, 1, 1, -1, 0), 20)], 5)
    assert model.prior > 0.7 and all(a > 0.6 for a in model.accuracies()[3:])
    assert model == quality.fit_label_model([(good, 800), (bad, 150), ((1, 1, 1, -1, 0), 20)], 5)
    assert quality.fit_label_model([], 3).prior == 0.8


def test_filter_keeps_columns_and_handles_an_empty_table(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    df = spark.createDataFrame([(1, prose, "a"), (2, "short", "b"), (None, None, None)], "doc_id long, text string, `odd name` string")
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    assert quality.filter_quality(df.limit(0)).count() == 0


def measured(text):
    t = text or ""
    n, chars, symbols, dup, repeat = brute(text)
    solid = [c for w in WORD.findall(t) for c in w]
    kinds = [unicodedata.category(c) for c in t]
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_distinct": len(set(WORD.findall(t))), "n_lines": len([x for x in t.split("\n") if WORD.search(x)]),
            "n_exclaim": sum(c in "!?" for c in solid), "n_alnum": sum(k[0] in "LN" for k in kinds), "n_upper": sum(k == "Lu" for k in kinds)}


def plain_votes(m):
    """The ten rules, written again."""
    n, chars = m["n_words"], m["word_chars"]
    length = -1 if n < 50 else 1 if n >= 100 else 0
    size = -1 if chars < 2 * n or chars > 14 * n else 1 if 3 * n <= chars <= 9 * n else 0
    prose = 1 if m["n_alnum"] >= 0.95 * chars and m["n_dup_lines"] == 0 and 100 * m["n_upper"] <= 15 * chars else 0
    defects = [100 * m["n_symbols"] > 20 * n, m["n_alnum"] < 0.93 * chars, 100 * m["n_dup_lines"] > 30 * m["n_lines"], 100 * m["n_repeat_words"] > 30 * n, m["n_distinct"] < 0.2 * min(n, 1000), 100 * m["n_upper"] > 40 * chars, 100 * m["n_exclaim"] > 30 * n]
    return (length, size, prose, *(-int(d) for d in defects))


def plain_em(all_votes):
    """Expectation-maximisation over single documents, with the prior beliefs as pseudo-counts."""
    prior_good, prior_bad = {-1: 0.02, 0: 0.18, 1: 0.80}, {-1: 0.20, 0: 0.30, 1: 0.50}
    good, bad, share, base = [prior_good] * 10, [prior_bad] * 10, 0.8, 0.1 * len(all_votes)
    odds = lambda v: math.log(share / (1 - share)) + sum(math.log(good[j][x] / bad[j][x]) for j, x in enumerate(v) if x)
    for _ in range(200):
        p = [1 / (1 + math.exp(-odds(v))) for v in all_votes]
        new = []
        for own, before in ((p, prior_good), ([1 - x for x in p], prior_bad)):
            tables = []
            for j in range(10):
                seen = {x: base * before[x] + sum(w for w, v in zip(own, all_votes, strict=True) if v[j] == x) for x in (-1, 0, 1)}
                tables.append({x: c / sum(seen.values()) for x, c in seen.items()})
            new.append(tables)
        good, bad = new
        share = (sum(p) + base * 0.8) / (len(all_votes) + base)
    return [1 / (1 + math.exp(-odds(v))) for v in all_votes]


def test_posterior_and_verdict_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-i, t) for i, t in enumerate(TEXTS, 1)]
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counts = [measured(t) for _, t in rows]
    posterior = plain_em([plain_votes(m) for m in counts])
    for (d, _), m, p in zip(rows, counts, posterior, strict=True):
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert abs(got[d].quality - p) < 1e-4
        assert got[d].base_failed == failed and got[d].kept == (not failed and p >= 0.5)


def test_any_column_names(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    names = ["row", "q", "m", "__q", "__m", "__base_failed", "base_failed", "kept", "quality", "v0", "n_words", "a.b"]
    df = spark.createDataFrame([(1, prose, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    assert [tuple(r) for r in quality.filter_quality(df).collect()] == [(1, prose, *names)]
    assert quality.quality_report(df).first().kept
