import gzip
import json

import pytest
from pathlode.sources import documents as d


def test_json_walk_keeps_numbers_and_last_keys():
    rows = list(d.walk(d.parse_json('{"b":[1,1.0,"x",null,true,{"c":18446744073709551615}],"a":1,"a":2e0}')))
    assert rows[0][:3] == ("$", 0, "object")
    assert ("$.a", 1, "float", "2e0", 2.0) in rows and ("$.b[*]", 2, "float", "1.0", 1.0) in rows
    assert ("$.b[*].c", 3, "integer", "18446744073709551615", 18446744073709551615.0) in rows


def test_nesting_limit():
    with pytest.raises(d.ParseError):
        list(d.walk(json.loads("[" * 300 + "]" * 300)))


@pytest.mark.parametrize(
    ("text", "kind"),
    [('{"a":1}', "json"), ('{"a":1}\n{"a":2}', "ndjson"), ("[1]", "json"), ("# T", "markdown"), ("---\na: 1", "yaml"), ("- a", "yaml"), ("key: v", "yaml"), ("% time  seconds", "strace"), ("1", "json")],
)
def test_sniff(text, kind):
    assert d.sniff(text) == kind


def test_csv_cells_and_ragged_rows():
    assert d.parse_csv("a,b,c\n1,2.50,x\n,+3\n9,8,7,6\n") == [{"a": 1, "b": 2.5, "c": "x"}, {"a": None, "b": 3}, {"a": 9, "b": 8, "c": 7}]


def test_yaml_merge_keys_and_documents():
    assert d.parse_yaml("base: &b {x: 1, y: 2}\nown: {<<: *b, y: 3}")["own"] == {"x": 1, "y": 3}
    assert d.parse_yaml("a: 1\n---\n---\nb: 2") == [{"a": 1}, {"b": 2}]


def test_compression_by_bytes():
    assert d.decompress("x.bin", gzip.compress(b"hi")) == ("x.bin", b"hi")
    assert d.decompress("x.json.gz", gzip.compress(b"hi")) == ("x.json", b"hi")


def test_markdown_tree():
    tree = d.parse_markdown("# A\ntext [l](u)\n\n## B\n- one\n- two\n\n```\ncode\n```\n# C\n> q\n\n| a |\n")
    assert [s["heading"] for s in tree["sections"]] == ["A", "C"] and tree["sections"][0]["subsections"][0]["content"][0]["text"] == ["one", "two"]
    assert {k: tree["metadata"][k] for k in ("heading_count", "list_count", "code_block_count", "link_count", "quote_count", "table_count")} == {"heading_count": 3, "list_count": 1, "code_block_count": 1, "link_count": 1, "quote_count": 1, "table_count": 1}


def test_strace_and_cpuprofile():
    rows = d.parse_strace("% time seconds usecs/call calls errors syscall\n 60.00 0.5 10 50 3 read\n 40.00 0.1 5 20 write\n100.00 0.6 15 70 3 total\n")
    assert [(r["syscall"], r["errors"]) for r in rows] == [("read", 3), ("write", 0)]
    prof = {"nodes": [{"id": 1, "callFrame": {"functionName": "f", "url": "app.js"}}, {"id": 2, "callFrame": {"functionName": "", "url": "node:fs"}}], "samples": [1, 1, 2]}
    assert [(r["function"], r["source"], r["samples"]) for r in d.parse_cpuprofile(prof)] == [("f", "app", 2), ("(anonymous)", "runtime", 1)]


def test_canonical_json():
    assert d.canonical_json({"b": [1.0, -0.0, 1e30, 1e-7, True, None], "a": "é"}) == '{"a":"é","b":[1,0,1e+30,1e-7,true,null]}'


def test_nodes_of_texts_and_files(spark, tmp_path):
    texts = spark.createDataFrame([(1, '{"k": 1}'), (2, "{bad"), (3, None)], "id long, body string")
    assert {(r.record_id, r.path) for r in d.json_nodes(texts, "id", "body", on_error="skip").collect()} == {(1, "$"), (1, "$.k")}
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'{"x": "z"}'))
    (tmp_path / "c.ndjson").write_text('{"x": 1}\n\n{"x": 2}\n')
    got = {(r.record_id.rsplit("/", 1)[-1], r.path, r.value) for r in d.read_documents(spark, str(tmp_path)).where("value is not null").collect()}
    assert got == {("a.csv", "$[*].x", "1"), ("a.csv", "$[*].y", "2"), ("b.json.gz", "$.x", "z"), ("c.ndjson", "$[*].x", "1"), ("c.ndjson", "$[*].x", "2")}
    assert d.read_ndjson(spark, str(tmp_path / "c.ndjson")).where("path = '$[*].x'").count() == 2
