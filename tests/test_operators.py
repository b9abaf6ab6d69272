import base64
import math
import random
from datetime import datetime

import pytest
from pathlode.functions import complexity, recognizers, redaction
from pathlode.operators import drift, essence, fingerprints, governance, relations, separation, temporal
from pathlode.plans import catalogue, query
from pathlode.sources.tables import table_nodes
from pyspark.sql import functions as F


def test_two_samples(spark):
    rng = random.Random(1)
    a, b = [rng.randrange(20) for _ in range(60)], [rng.randrange(5, 30) for _ in range(45)]
    rows = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, num double").withColumn("path", F.lit("p"))
    r = drift.ordered_comparison(drift.paired_counts(rows, "g", "num", drift.group_pairs(rows, "g")), ("group_a", "group_b")).first()
    delta = sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))
    cdf = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    w = sum(abs(cdf(a, v) - cdf(b, v)) for v in range(0, 30))
    assert r.cliffs_delta == pytest.approx(delta) and r.wasserstein == pytest.approx(w) and r.auc == pytest.approx((delta + 1) / 2)


def test_jsd_is_symmetric_and_bounded(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "x")], "g string, v string").withColumn("path", F.lit("p"))
    got = {(r.group_a, r.group_b): r.jsd for r in drift.jensen_shannon(drift.paired_counts(rows, "g", "v", drift.group_pairs(rows, "g")), ("group_a", "group_b")).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["b", "c"] == pytest.approx(1.0) and 0 < got["a", "c"] < 1


def test_full_drift_severity(spark):
    left = table_nodes(spark.createDataFrame([(1, "a")], "k int, old string"))
    right = table_nodes(spark.createDataFrame([("1", "a")], "k string, new string"))
    r = drift.full_drift(left, right).first()
    assert (r.added, r.removed, r.shared, r.changed, r.severity) == (1, 1, 2, 1, "critical")


def test_relationship_of_a_function(spark):
    rows = spark.createDataFrame([(i % 6, i % 3, i % 2) for i in range(60)], "six int, three int, two int")
    got = {(r.field_x, r.field_y): r for r in relations.discover(rows).collect()}
    assert got["six", "three"].relationship_strength == pytest.approx(1.0) and got["six", "three"].mutual_information == pytest.approx(math.log2(3))
    assert got["two", "three"].relationship_strength == pytest.approx(0.0, abs=1e-9)


def test_quantile_bins_keep_ties_together(spark):
    rows = spark.createDataFrame([(float(x),) for x in [1] * 10 + list(range(2, 12))], "x double")
    got = {(r.x): r["count"] for r in relations.binned(rows, "x", 4).groupBy("x").count().collect()}
    assert sum(got.values()) == 20 and got["0"] == 10


def test_operating_point(spark):
    rows = spark.createDataFrame([(s, "y" if s > 5 else "n") for s in range(11)], "score int, label string")
    r = separation.operating_point(rows, "label", "y", ["score"]).first()
    assert (r.rule, r.threshold, r.tpr, r.fpr) == (">=", 6.0, 1.0, 0.0)
    assert separation.auc(rows, "label", "y", ["score"]).first().auc == 1.0
    with pytest.raises(separation.SeparationError):
        separation.separation(rows, "nope", ["score"])


def test_times(spark):
    cases = {"2021-01-01T10:00:00+02:00": datetime(2021, 1, 1, 8), "2021-01-01T10:00:00.5+02:00": datetime(2021, 1, 1, 10), "2021-01-01": datetime(2021, 1, 1), "1/31/2021": datetime(2021, 1, 31), "31.1.2021": datetime(2021, 1, 31), "1000000000": datetime(2001, 9, 9, 1, 46, 40), "2021-13-01": None, "x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.t for r in rows.select("s", temporal.parse_time(F.col("s")).cast("string").alias("t")).collect()}
    assert got == {k: v and v.strftime("%Y-%m-%d %H:%M:%S") for k, v in cases.items()}
    labels = spark.createDataFrame([("2021-01-01",)], "s string").select(temporal.window_label(F.col("s").cast("timestamp"), "week")).first()
    assert labels[0] == "2020-W53"


def test_trend_of_a_constant_series(spark):
    rows = spark.createDataFrame([("m", w, 3.0) for w in "abc"] + [("u", w, float(i)) for i, w in enumerate("abc")], "name string, w string, y double")
    got = {r.name: (r.direction, r.r_squared) for r in temporal.trend(rows, ["name"], "w", "y").collect()}
    assert got["m"] == ("decreasing", 1.0) and got["u"][0] == "increasing"


def test_cascades(spark):
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(["feat", "fix a", "fix b", "feat", "docs", "revert x"])], "file string, day int, intent string")
    found = temporal.cascades(rows, "file", ["day"], "intent", ["fix", "revert"])
    assert {(r.trigger, r.response) for r in found.collect()} == {("feat", "fix a"), ("docs", "revert x")}
    assert temporal.hot_entities(rows, found, "file", "intent").first().cascade_ratio == pytest.approx(2 / 6)


def test_concentration_by_hand(spark):
    counts = [10, 5, 5, 2, 1, 1, 1]
    rows = spark.createDataFrame([(f"a{i}",) for i, n in enumerate(counts) for _ in range(n)], "author string")
    r = governance.concentration(governance.author_counts(rows, "author")).first()
    total = sum(counts)
    running = [sum(counts[: k + 1]) for k in range(7)]
    bus = lambda t: next(k + 1 for k in range(7) if running[k] >= math.ceil(total * t))
    asc = sorted(counts)
    gini = 2 * sum((i + 1) * c for i, c in enumerate(asc)) / (7 * total) - 8 / 7
    assert (r.bus_factor_50, r.bus_factor_80, r.unique_authors) == (bus(0.5), bus(0.8), 7)
    assert r.gini_coefficient == pytest.approx(gini) and r.top3_share == pytest.approx(20 / 25) and r.one_commit_rate == pytest.approx(3 / 7)
    with pytest.raises(governance.MissingField):
        governance.author_counts(rows, "nobody")


def test_identities(spark):
    rows = spark.createDataFrame([("Ann", "a@x"), ("Ann", "b@x"), ("A. Lee", "12+B@x"), ("Bob", "c@x"), ("Ann", "a@x")], "name string, email string")
    got = {(r.name, r.email): r.canonical for r in governance.identities(rows, "name", "email").collect()}
    assert got == {("Ann", "a@x"): "Ann", ("Ann", "b@x"): "Ann", ("A. Lee", "b@x"): "Ann", ("Bob", "c@x"): "Bob"}


def test_health_grades(spark):
    r = governance.health(spark.createDataFrame([(0.1, 5.5)], "top1_share double, commit_entropy double")).first()
    assert (r.grade_bus_factor, r.grade_contribution_diversity, r.grade_code_stability, r.overall_grade) == ("A", "A", None, "A")


def test_merkle_shapes():
    shape = lambda v: fingerprints.merkle(v)[0]
    assert shape({"a": 1, "b": [2]}) == shape({"b": [9], "a": 5}) != shape({"a": 1, "b": [2, 3]})
    assert shape({"a": 1}) != shape({"a": 1.5})
    assert max(fingerprints.merkle([{"x": 1}, {"x": 2}])[1].values()) == 2


def test_jaccard_pairs_against_brute_force(spark):
    rng = random.Random(3)
    sets = {i: {rng.randrange(25) for _ in range(rng.randrange(1, 9))} for i in range(80)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "d int, i int")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5}
    assert {(r.a, r.b) for r in fingerprints.jaccard_pairs(rows, "d", "i").collect()} == want


def test_clusters(spark):
    docs = spark.range(8).withColumnRenamed("id", "d")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    got = {r.d: (r.cluster, r["size"]) for r in fingerprints.clusters(docs, "d", edges).collect()}
    assert got == {0: (0, 4), 1: (0, 4), 2: (0, 4), 3: (0, 4), 4: (4, 1), 5: (5, 2), 6: (5, 2), 7: (7, 1)}


def _brute_clusters(sets):
    names = sorted(sets)
    root = {d: d for d in names}
    for x in names:
        for y in names:
            if x < y and len(sets[x] & sets[y]) > 0.5 * len(sets[x] | sets[y]) and root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_similar_links_against_brute_force(spark):
    """Sets just over the threshold, chains that the smallest member is not part of, and equal sets."""
    rng = random.Random(8)
    sets = {}
    for g in range(60):
        base = rng.sample(range(3000), 30)
        for k in range(3):
            sets[len(sets)] = set(base[k * rng.randrange(1, 6) : 24 + k]) | set(rng.sample(range(3000), rng.randrange(1, 7)))
    for d in range(5):
        sets[len(sets)] = set(sets[d])
    rows = spark.createDataFrame([(d, i) for d, s in sets.items() for i in s], "d long, i long")
    got = {r.d: r.cluster for r in fingerprints.clusters(rows, "d", fingerprints.similar_links(rows, "d", "i")).collect()}
    want = _brute_clusters(sets)
    assert got == want and 60 < len(set(want.values())) < 170
    pairs = {(r.a, r.b) for r in fingerprints.lsh_pairs(fingerprints.minhash_signatures(rows, "d", "i"), "d", bands=128).collect()}
    shared = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) > 0.5 * len(sets[x] | sets[y])}
    assert shared <= pairs


def test_similar_links_of_document_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    rows = docs.select(F.col("doc_id").alias("d"), F.explode(F.split(F.lower("text"), "[ \\n]+")).alias("i")).where("i <> ''")
    sets = {}
    for r in rows.distinct().collect():
        sets.setdefault(r.d, set()).add(r.i)
    got = {r.d: r.cluster for r in fingerprints.clusters(rows, "d", fingerprints.similar_links(rows, "d", "i")).collect()}
    want = _brute_clusters(sets)
    assert got == want and len(set(want.values())) < len(want)


def test_lz76():
    assert complexity.lz76_phrases(b"") == 0 and complexity.lz76_phrases(b"a") == 1
    rng = random.Random(2)
    noise = bytes(rng.randrange(256) for _ in range(1000))
    assert complexity.lz76_complexity(b"a" * 1000) < complexity.lz76_complexity(noise)


def test_lz76_against_plain_search():
    rng = random.Random(4)
    for _ in range(200):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(60)))
        at = phrases = 0
        while at < len(data):
            size = 0
            while at + size < len(data) and data[at : at + size + 1] in data[:at]:
                size += 1
            at, phrases = at + size + 1, phrases + 1
        assert complexity.lz76_phrases(data) == phrases


def test_lz_complexity_takes_every_value(spark, tmp_path):
    """The first 100 values in alphabetical order are alike, the others are not."""
    rng = random.Random(6)
    users = [10**12 + k for k in range(100)] + [rng.randrange(2 * 10**12, 9 * 10**12) for _ in range(150)]
    spark.createDataFrame([(u, "view") for u in users], "user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["lz_complexity"](spark, str(tmp_path)).collect()
    want = complexity.lz76_complexity("\x01".join(sorted(map(str, set(users)))).encode())
    assert [(r.event_type, r.lz_complexity) for r in got] == [("view", round(want, 6))]


def test_recognizers(spark):
    cases = {"CVE-2021-44228": "cve_id", "10.0.0.1": "ipv4", "::1": "ipv6", "fe80::1": "ipv6", "10.0.0.0/8": "cidr", "AA:bb:cc:dd:ee:ff": "mac_address", "T1059.001": "mitre_attack_id", "arn:aws:s3:::bucket": "aws_arn", "J45.909": "icd10", "snake_case_name": "snake_case_identifier", "#12": "pr_number_ref", "%41%42 x": "url_encoded", "Apache-2.0 x y z!": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.k for r in rows.select("v", recognizers.recognize(F.col("v")).alias("k")).collect()}
    assert got == cases
    assert recognizers.encoding_layers("aGVsbG8gd29ybGQhIQ==") == ["base64"] and recognizers.encoding_layers("%68%69") == ["url"]


def test_recognizers_that_decode(spark):
    inner = base64.b64encode(b"a text that is long enough").decode()
    cases = {
        base64.b64encode(b"hello hello hello hello!").decode(): ["base64"],
        "eyJ" + "a" * 21: [],
        base64.b64encode(b"aaaabbbbccccdddd").decode(): ["base64"],
        "AAAA" * 5: [],
        "0123456789abcdef" * 3: ["base64", "hex_encoded"],
        "0123456789abcdef" * 4: ["base64"],
        "0" * 34: [],
        "%2541%2542": ["double_encoded"],
        base64.b64encode(inner.encode()).decode(): ["base64", "double_encoded"],
        "&amp; %41": ["mixed_encoding"],
        "\\u0041 &lt;": ["mixed_encoding"],
        "plain words": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: [n for n in recognizers.DECODED if r[n]] for r in rows.select("v", *[recognizers.matches(F.col("v"), n).alias(n) for n in recognizers.DECODED]).collect()}
    assert {k: v for k, v in got.items() if "0123" not in k} == {k: v for k, v in cases.items() if "0123" not in k}
    assert "hex_encoded" in got["0123456789abcdef" * 3] and "hex_encoded" not in got["0123456789abcdef" * 4]
    named = {r.v: r.k for r in rows.select("v", recognizers.recognize(F.col("v"), ("encoding",)).alias("k")).collect()}
    assert named[next(iter(cases))] == "base64" and named["plain words"] is None and named["%2541%2542"] == "url_encoded"


def test_every_group_is_registered(spark, tmp_path):
    text = "CVE-2021-44228 J45.909 v1.2.3 MERGED snake_case ^1.2 " + base64.b64encode(b"hello hello hello hello!").decode()
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.domain, r.semantic_type): r.n for r in catalogue.QUERIES["recognized_groups"](spark, str(tmp_path)).collect()}
    want = {("security", "cve_id"), ("medical", "icd10"), ("devops", "semver"), ("github", "pr_state"), ("github", "github_login"), ("source", "snake_case_identifier"), ("package", "semver_range"), ("encoding", "base64")}
    assert want <= set(got) and got["security", "cve_id"] == 1


def test_redaction(spark):
    cases = {"ssn 123-45-6789 a@b.co": "ssn [SSN] a@b.co", "mail A.b@c-d.org": "mail [EMAIL]", "call (555) 123-4567": "call [PHONE]", "card 4111-1111-1111-1111 ok": "card [CREDIT_CARD] ok", "card 4111-1111-1111-1112": "card 4111-1111-1111-1112", "on 2001-02-03": "on 2001-02-03", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.r for r in rows.select("v", redaction.redact(F.col("v")).alias("r")).collect()} == cases
    born = rows.where("v = 'on 2001-02-03'").select(redaction.redact(F.col("v"), F.lit("date_of_birth"))).first()[0]
    assert born == "on [DATE_OF_BIRTH]"


def test_query_language(spark):
    nodes = table_nodes(spark.createDataFrame([(1, "a", [1]), (2, "b", [2, 3])], "k int, s string, l array<int>"))
    value = lambda q: [r.value for r in query.run(nodes, q).collect()]
    assert value("count($[*].l[*])") == [3.0] and value("entropy($[*].s) == 1") == [1.0] and value("entropy($[*].s) > 1") == [] and value("depth($[*].l[*])") == [3.0]
    assert {r.path for r in query.run(nodes, "$[*].* >= 2").collect()} == {"$[*].k", "$[*].s", "$[*].l"}
    assert query.run(nodes, "$.**.s").count() == 2 and value("2 < 3") == [2.0]
    for bad, error in (("nope($.a)", query.UnknownFunction), ("entropy($.a", query.QuerySyntaxError), ("1 +", query.QuerySyntaxError), ('"a" < 1', query.QueryTypeError), ("1 < $.a", query.QueryTypeError), ("", query.QuerySyntaxError)):
        with pytest.raises(error):
            query.run(nodes, bad)


def test_essence_budget_and_profiles():
    rows = [{"rank": i, "path": f"$.p{i}" * (9 if i == 2 else 1), "kind": "enum_like", "score": 1.0 - i / 10} for i in range(1, 6)]
    cut = essence.apply_budget(rows, 14)
    assert [r["rank"] for r in cut] == sorted(r["rank"] for r in cut) and 0 < len(cut) < 5
    assert sum(len(c["rows"]) for c in essence.chunk(rows, 10)) == 5
    assert essence.load_profiles("[profiles.mine.weights]\nrarity = 1.0\n")["mine"].weights[0] == 1.0
    assert "enum_like" in essence.render_text(rows) and essence.render_compact(rows)["d"]
    assert all(abs(sum(w) - 1) < 1e-9 for w in essence.PROFILES.values())


def test_quadrants_are_strictly_over_the_cut(spark):
    from pathlode.functions import information

    rows = spark.createDataFrame([(0.5, 0.5), (0.6, 0.5), (0.5, 0.6), (0.6, 0.6)], "e double, c double")
    assert [r[0] for r in rows.select(information.quadrant(F.col("e"), F.col("c"))).collect()] == ["constant", "structured", "anomalous", "random"]


def test_operating_category(spark):
    rows = spark.createDataFrame([("a", "1")] * 3 + [("b", "1"), ("a", "0"), ("b", "0"), (None, "0"), (None, "0")], "f string, y string")
    row = separation.operating_category(rows, "y", "1", ["f"], base_rate=0.5).first()
    assert (row.rule, row.value, row.tpr, row.fpr, row.youden_j) == ("!=", "(absent)", 1.0, 0.5, 0.5)
    assert separation.operating_category(rows.where("y = '1'"), "y", "1", ["f"]).count() == 0


def test_self_fix_rate(spark):
    rows = spark.createDataFrame([("f", 1, "feat", "A"), ("f", 2, "fix", "A"), ("f", 3, "feat", "A"), ("f", 4, "fix", "B"), ("g", 1, "fix", "C")], "file string, t int, kind string, author string")
    found = temporal.cascades(rows, "file", ["t"], "kind", ["fix"], keep=["author"])
    assert tuple(temporal.cascade_summary(rows, found, "file", "author").first()) == (5, 2, 0.4, 0.5)
    assert temporal.cascade_summary(rows, temporal.cascades(rows, "author", ["t"], "kind", ["fix"], keep=["author"]).withColumn("author", F.lit("A")).withColumn("next_author", F.lit("A")), "author", "author").first().self_fix_rate is None
    assert tuple(temporal.cascade_summary(rows.where("false"), found.where("false"), "file", "author").first()) == (0, 0, 0.0, 0.0)
