import random

import xxhash
from pathlode.llm import line_dedup
from pyspark.sql import functions as F


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def cut(text):
    """(place, lines) of the content-defined chunks, computed anew."""
    lines = text.split("\n")
    h = [xx(x.encode()) for x in lines]
    mark = [False] + [(xx(h[i - 1].to_bytes(8, "little"), xx(h[i].to_bytes(8, "little")))) for i in range(1, len(h))]
    mark = [m if isinstance(m, bool) else ((m - (1 << 64) if m >> 63 else m) % line_dedup.MODULUS == 0) for m in mark]
    starts = [0] + [i + 1 for i in range(1, len(h) - 2) if mark[i] and (i == 1 or not mark[i - 1])]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]


def test_chunks_are_cut_as_defined(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(["a", "b", f"line {rng.random()}", "", "é"]) for _ in range(rng.randrange(1, 60))) for _ in range(80)] + ["", "one", "a\nb", "\n" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", line_dedup.chunks(F.col("text")).alias("c")).collect():
        assert "\n".join(c.body for c in r.c) == r.text
        assert [c.n_lines for c in r.c] == [n for _, n in cut(r.text)]
        assert len(r.c) == 1 or min(c.n_lines for c in r.c) >= 2


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    passage = [f"shared {rng.random()}" for _ in range(400)]
    own = lambda n: [f"own {rng.random()}" for _ in range(n)]
    a, b = [set("\n".join(lines[at : at + n]) for at, n in cut("\n".join(lines))) for lines in (own(1) + passage, own(4) + passage + own(2))]
    assert len(a & b) > 0.9 * len(a)


def test_two_equal_texts_leave_one(spark):
    df = spark.createDataFrame([(1, "\n".join("abcdef")), (2, "\n".join("abcdef"))], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.remove_repeated_passages(df).collect()} == {1: "\n".join("abcdef"), 2: ""}


def test_very_common_passages_and_many_lines(spark):
    common = "a very common line\nand the one after it"
    df = spark.range(6000).selectExpr("id AS doc_id", f"concat('own ', id, '\n{common}') AS text", "1 AS h", "2 AS c")
    got = line_dedup.remove_repeated_passages(df).groupBy("n_removed_lines").count().collect()
    assert {r.n_removed_lines: r["count"] for r in got} == {0: 1, 2: 5999}
    many = "\n".join(f"line {k % 5000}" for k in range(20_000))
    long = spark.createDataFrame([(1, many), (2, "z" * 1_000_000 + "\n" + "z" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.remove_repeated_passages(long).collect()}
    assert got[1].text == "\n".join(f"line {k}" for k in range(5000)) and got[2].n_removed_lines == 1


def test_empty_table(spark):
    assert line_dedup.remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_passages_between_private_lines(spark):
    """Passages planted without regard to chunks: every one is found, and nothing else goes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    line = lambda n=8: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for p in range(80):
        passage = [line() for _ in range(2 + p % 6)] if p % 8 else [line(40)]
        if p % 8 == 3:
            passage.insert(1, " ")
        for copy in range(2):
            before, after = [line() for _ in range(rng.randrange(0, 6))], [line() for _ in range(rng.randrange(1, 6))]
            rows.append((p + 100 * copy, "\n".join(before + passage + after)))
            planted[p + 100 * copy] = (len(passage) if copy else 0, "\n".join(before + (passage if not copy else []) + after))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in line_dedup.remove_repeated_passages(df).collect()}
    assert got == planted


def test_passages_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {k}" for k in range(8)] + ["", " \t", "long " * 50, "x" * 199]
    rows = [(d if d % 7 else None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for d in range(1, 41)]
    rows += [(50, "la\nla\nla\nla"), (51, "a1\nb1\na1\nb1\na1"), (52, None), (53, ""), (54, "\n\n\n"), (55, "\n\n\n"), (56, "word\n"), (57, "word\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen, expected = {}, []
    for place, (d, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        if t is None:
            expected.append((d, 0, 0, None))
            continue
        lines, gone = t.split("\n"), set()
        has = [bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        units = []
        for at, n in cut(t):
            units += [("chunk", at, n)] if n >= 2 and any(has[at : at + n]) else []
        full = [i for i, x in enumerate(has) if x]
        units += [("pair", i, j - i + 1) for i, j in zip(full, full[1:], strict=False)]
        units += [("line", i, 1) for i in full if len(lines[i]) >= 200]
        for kind, i, n in units:
            first = seen.setdefault((kind, "\n".join(lines[i : i + n])), (place, i, n))
            if first[:2] != (place, i):
                gone |= set(range(max(i, first[1] + first[2]) if first[0] == place else i, i + n))
        expected.append((d, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    got = [(r.doc_id, r.n_lines, r.n_removed_lines, r.text) for r in line_dedup.remove_repeated_passages(df).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert {r[0]: r[3] for r in expected}[50] == "la\nla"
