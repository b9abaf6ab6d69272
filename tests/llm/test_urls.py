import random

from pathlode.llm import queries, urls


def brute(url, entries):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [e for e in entries if (host == e[0] or host.endswith("." + e[0])) and path.startswith(e[1])]
    best = max(fits, key=lambda e: (e[4], len(e[0]) + len(e[1]), len(e[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_against_brute_force(spark):
    entries = [tuple(r) for r in queries.url_entries(spark).collect()]
    hosts = ["net", "a.net", "xnet", "example.net", "b.EXAMPLE.net", "example.com", "d.example.com", "org", "x.org", "spam-farm.example.org", "www.casino-win.example.net", "É.net", ""]
    paths = ["", "/", "/en/", "/en", "/de/x?y#z", "/fr/#a", "?q=/en/", "#f", "//", "/en/" + "a" * 5000]
    cases = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths] + [None, "", "nothing", "a://b://net/", "http://net/\n/en/"]
    rows = [(i, u, "clash") for i, u in enumerate(cases)] + [(0, cases[0], "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.filter_urls(df, queries.url_entries(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.entry, r.verdict) == brute(cases[r.page_id], entries), cases[r.page_id]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).selectExpr("concat('h', id, '.com') AS host", "'/' AS path", "'block' AS verdict", "'listed' AS kind", "0 AS rank")
    pages = spark.range(8000).selectExpr("id AS page_id", "concat('http://h', id, '.com/x') AS url")
    got = urls.filter_urls(pages, listed).selectExpr("count_if(page_id < 2000 and maybe) AS hit", "count_if(page_id >= 2000 and maybe) AS extra", "count_if(verdict = 'block') AS blocked").first()
    assert (got.hit, got.blocked) == (2000, 2000)
    assert got.extra < 120


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    entries = queries.url_entries(spark)
    assert urls.filter_urls(none, entries).count() == 0
    one = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert urls.filter_urls(one, entries.limit(0)).first().verdict == "allow"


def test_long_lists_deep_paths_ties_and_clashing_names(spark):
    rng = random.Random(8)
    hosts = [".".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randrange(1, 5))) + rng.choice([".com", ".org"]) for _ in range(60)]
    path = lambda: "".join("/" + rng.choice(["x", "y", "xy", ""]) for _ in range(rng.randrange(0, 9)))
    entries = [(rng.choice(hosts), path(), rng.choice(["block", "allow"]), "listed", rng.randrange(2)) for _ in range(4000)]
    entries = list({e[:2]: e for e in entries}.values()) + [("", "/", "block", "listed", 9), ("tie.com", "/", "allow", "listed", 1), ("tie.com", "/", "block", "listed", 1)]
    urls_ = [f"http://{rng.choice(hosts)}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(800)] + ["http://www.tie.com/", "http:///x", None, "http://" + "a." * 2000 + "com/" + "x/" * 20_000]
    rows = [(i, u, *["clash"] * 7) for i, u in enumerate(urls_)]
    df = spark.createDataFrame(rows, "page_id long, url string, best string, k1 string, n string, h string, row string, __r string, `a.b` string")
    got = urls.filter_urls(df, spark.createDataFrame(entries, "host string, path string, verdict string, kind string, rank int")).collect()
    assert len(got) == len(rows)
    fair = [e for e in entries if e[0] and e[:3] != ("tie.com", "/", "allow")]
    for r in got:
        want = brute(urls_[r.page_id], fair)
        assert (r.host, r.path, r.verdict) == (*want[:2], want[3]) and (r.entry or "") == (want[2] or "") and r.best == "clash"


def test_very_common_urls(spark):
    pages = spark.range(30_000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN 'http://x.net/hot' WHEN id % 3 = 1 THEN null ELSE concat('http://y.example.net/en/', id) END AS url")
    got = urls.filter_urls(pages, queries.url_entries(spark)).groupBy("verdict", "entry").count().collect()
    assert {(r.verdict, r.entry, r["count"]) for r in got} == {("block", "net/", 10_000), ("allow", None, 10_000), ("allow", "example.net/en/", 10_000)}
