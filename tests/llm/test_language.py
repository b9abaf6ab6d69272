import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pathlode.llm import language, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
TEXTS = {"aa": ["banana bandana", "an Anna, naan"], "oo": ["solo polo tool", "Oslo!! looo"], "zh": ["漢字假名交じり文", "漢文 假名"]}


def kneser_ney(texts, order=4, d=0.75):
    """Interpolated Kneser-Ney in plain Python dictionaries: chance of a character after a context."""
    v = 0x110000
    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        padded = " " * (order - 2) + normal(text)
        for i in range(order - 1, len(padded)):
            counts[order][padded[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    totals = [defaultdict(lambda: [0, 0]) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for gram, c in counts[n].items():
            totals[n][gram[:-1]][0] += c
            totals[n][gram[:-1]][1] += 1

    def chance(gram):
        n = len(gram)
        if n == 0:
            return 1 / v
        total, kinds = totals[n].get(gram[:-1], (0, 0))
        if not total:
            return chance(gram[1:])
        return max(counts[n][gram] - d, 0) / total + d * kinds / total * chance(gram[1:])

    return chance


def normal(text):
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return " " + " ".join(kept.split()) + " "


def tiny(texts=TEXTS, order=4):
    model = language.Model(order=order)
    for lang, own in texts.items():
        model.levels[lang] = language.fit_language(*language.gram_counts(iter(own), order))
    return model


def test_held_out_accuracy_and_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~held))
    got = language.identify(docs, model, extra={"held_out": held}).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").cache()
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
    assert set(model.languages) == {"de", "en", "es", "fr"}
    assert got.agg(F.avg("score")).first()[0] > 0.95 and got.where("score > 0.5").count() > 0.97 * got.count()


def test_a_language_that_was_never_labelled_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where("lang <> 'fr'"))
    french = language.identify(docs.where("lang = 'fr' and n_chars > 300"), model)
    share = french.agg(F.avg(F.col("rejected").cast("int")), F.min("score")).first()
    assert share[0] > 0.9 and share[1] < 0.1
    known = language.identify(docs.where("lang in ('de', 'en', 'es') and n_chars > 300"), model)
    assert known.agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.05


def test_entropies_against_plain_python():
    model = tiny()
    texts = ["banana polo", "zzz", "Anna's tool!!", "éà", "漢字 solo", "a" * 500, "नमस्ते दुनिया"]
    bits, lengths = model.entropies(texts)
    for j, lang in enumerate(model.languages):
        chance = kneser_ney(TEXTS[lang])
        for i, text in enumerate(texts):
            padded = "  " + normal(text)
            total = -sum(math.log2(chance(padded[k - 3 : k + 1])) for k in range(3, len(padded)))
            assert lengths[i] == len(normal(text)) - 1
            assert bits[i, j] == pytest.approx(total / lengths[i], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_other_orders(order):
    model, chance = tiny(order=order), kneser_ney(TEXTS["aa"], order)
    columns = [np.array([ord(c)], dtype=np.uint32) for c in "xbana"[-order:]]
    assert language.chances(model.levels["aa"], columns)[0] == pytest.approx(chance("xbana"[-order:]), rel=1e-9)


def test_probabilities_sum_to_one():
    model = tiny()
    places = np.arange(0x110000, dtype=np.uint32)
    for context in ("   ", " ba", "ana", "zzz", "漢字假"):
        columns = [np.full(len(places), ord(c), dtype=np.uint32) for c in context] + [places]
        for lang in model.languages:
            assert language.chances(model.levels[lang], columns).sum() == pytest.approx(1.0, abs=1e-9)


def test_long_texts_in_pieces(monkeypatch):
    model, text = tiny(), "solo banana tool " * 400
    whole = model.entropies([text, "anna"])[0]
    monkeypatch.setattr(language, "PIECE", 97)
    assert np.allclose(model.entropies([text, "anna"])[0], whole, rtol=1e-12)


def test_large_alphabets_are_told_apart(spark):
    """Two languages in rare letters of one large script: every letter counts."""
    low, high = [chr(0x4E00 + k) for k in range(1500)], [chr(0x6000 + k) for k in range(1500)]
    rows = [(i, "".join((low if i % 2 else high)[(i * 37 + k * 7) % 1500] for k in range(60)), "low" if i % 2 else "high") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id < 200"))
    got = language.identify(docs.where("doc_id >= 200"), model).join(docs, "doc_id")
    assert got.where("lang <> lang_pred").count() == 0


def test_odd_texts(spark):
    model = tiny({k: TEXTS[k] for k in ("aa", "oo")})
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "123 !?  ", 0.5), (4, "banana", 0.5), (4, "banana", 0.5), (5, "ΩΩ", 0.5), (6, "solo " * 50_000, 0.5), (None, "\U0001f600 an", 0.5), (7, "́́", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 6, 7)] == ["und", "und", "und", "aa", "oo", "und"]
    assert got[5].lang_pred in ("aa", "oo") and all(0 <= r.score <= 1 for r in got.values()) and got[1].score == 0
    assert language.identify(df.limit(0), model).count() == 0


def test_no_labels_one_language_and_null_ids(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(none, language.train(none)).first().lang_pred == "und"
    one = spark.createDataFrame([(None, f"some text here {chr(97 + i % 26)}", "en") for i in range(30)], "doc_id long, text string, lang string")
    assert language.identify(one, language.train(one)).first().lang_pred == "en"


def test_the_query_never_reads_labels_of_held_out_rows(spark):
    got = queries.op6_language(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and set(got.columns) >= {"doc_id", "held_out", "lang_pred", "score"}
