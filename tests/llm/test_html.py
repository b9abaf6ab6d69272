import html as H
import re
import time

from pathlode.llm.html_text import extract, extract_pages

PROSE = "Lorem ipsum dolor sit amet, consectetur, adipiscing elit, sed do eiusmod tempor incididunt ut labore."


def test_articles_of_the_test_pages(spark):
    for r in extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:h1|p|br|article)>", "\x01", body))
        want = " ".join(x for x in (re.sub(r"\s+", " ", H.unescape(x)).strip() for x in body.split("\x01")) if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_boilerplate_goes():
    page = f"""<!doctype html><html><head><title>T</title><script>var a="<p>x</p>"</script><style>p{{}}</style></head><body class="page no-sidebar">
      <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookie-banner"><p>{PROSE}</p></div>
      <div class="layout"><div class="main-content"><h1>Title &amp; more</h1><div class="ad"><p>{PROSE}</p></div><p>{PROSE}</p><p>a <a href=x>link</a>, b&nbsp;c
      <p>{PROSE} end<section class="comments"><p>{PROSE}</p></section><form><p>{PROSE}</p></form></div><div class="sidebar"><p>{PROSE}</p></div></div><footer>{PROSE}</footer></body></html>"""
    assert extract(page) == f"Title & more {PROSE} a link, b c {PROSE} end"


def test_odd_pages(spark):
    deep = "<div>" * 3000 + PROSE + "</div>" * 3000
    cases = [None, "", "<", "<p", "plain &lt;text&gt; &amp", "<p>a<p>b", "<!-- open", "<script>x", "<p>x</p", "<p>&#233; &#x2603;</p>", deep, f"<p>{'long, ' * 40_000}</p>"]
    df = spark.createDataFrame([(i, None, h, "clash") for i, h in enumerate(cases)] + [(3, "u", "<p>a<p>b", "x")] * 2, "page_id long, url string, html string, text string")
    got = extract_pages(df).collect()
    assert len(got) == len(cases) + 2
    by_id = {r.page_id: r.text for r in got if r.url is None}
    assert [by_id[i] for i in (0, 1, 3, 6, 7)] == [""] * 5
    assert by_id[4] == "plain <text> &" and by_id[5] == "a b" and by_id[9] == "é ☃" and by_id[10] == PROSE and len(by_id[11]) > 200_000
    assert extract_pages(df.limit(0)).count() == 0


def test_parts_of_an_article_stay_whatever_their_names():
    page = f"""<body><article><div class="article-header"><h1>The title</h1><p>by line</p></div><p>{PROSE}</p>
      <figure><img src=x><figcaption>Caption here.</figcaption></figure><p>Sum <math><mi>x</mi><mo>=</mo><mn>1</mn></math> ends.</p>
      <section id="discussion"><h2>Discussion</h2><p>{PROSE}</p><p>{PROSE}</p></section><div class="warning"><p>{PROSE} {PROSE} {PROSE} {PROSE}</p></div>
      <div class="related"><ul><li><a href=1>Other story one</a></li><li><a href=2>Other story two</a></li></ul></div>
      <div class="notice">We moved.</div><div class="share"><a href=3>Share this</a></div></article></body>"""
    assert extract(page) == f"The title by line {PROSE} Caption here. Sum x=1 ends. Discussion {PROSE} {PROSE} {PROSE} {PROSE} {PROSE} {PROSE}"


def test_inline_adverts_go_whole():
    assert extract(f"<p>{PROSE} <span class=ad>buy <span>now</span> cheap stuff</span> end</p>") == f"{PROSE} end"
    assert extract(f"<div><p>{PROSE} <span class=ad>buy <b>now</b></p><p>{PROSE} next</p></div>") == f"{PROSE} {PROSE} next"
    assert extract(f"<p>{PROSE} <a class='ad promo' href=x>buy</a> end <span class=big>and so on</span></p>") == f"{PROSE} end and so on"


def test_what_stands_beside_the_best_container_stays():
    page = f"""<body><div class="nav-bar"><a href=1>x</a></div><div class="wrap"><div class="post"><p>{PROSE}</p><p>{PROSE}</p></div><h3>Steps</h3><ul><li>first</li><li>second</li></ul>
      <blockquote>Said so.</blockquote>loose text<div class="post"><p>{PROSE}</p><p>{PROSE}</p></div><p>The end.</p><div class="share"><a href=2>Print</a></div></div></body>"""
    assert extract(page) == f"{PROSE} {PROSE} Steps first second Said so. loose text {PROSE} {PROSE} The end."


def test_equal_scores_go_to_the_first():
    one, two = PROSE.replace("Lorem", "First"), PROSE.replace("Lorem", "Other")
    assert extract(f"<body><div><section><p>{one}</p></section></div><div><section><p>{two}</p></section></div></body>").startswith("First")


def test_deep_and_unmatched_tags_take_linear_time():
    for page in ("<div>" * 20_000 + "</b></x>" * 20_000 + PROSE, "<center>" * 20_000 + "</p>" * 20_000 + PROSE, "<li><i>" * 20_000 + "</table>" * 20_000 + PROSE, "<span class=ad>" * 20_000 + PROSE):
        begun = time.perf_counter()
        extract(page)
        assert time.perf_counter() - begun < 20


def test_empty_table(spark):
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
