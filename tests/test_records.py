from pathlode.sources import records
from pyspark.sql import functions as F


def _records(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "d long, body string")
    return records.extract_records(rows, "d", "body")


def test_records_of_all_kinds(spark):
    found = _records(spark, '{"a":1}', '[{"a":1},2,{"a":2},"{"]', '{"x":[1],"p":{"q":[{"a":1}]},"y":[{"a":3},4]}', "[1]", "5", "no json", None, "[]", "{}", "null")
    got = sorted((r.d, r.pos, r.t) for r in found.select("d", "pos", F.to_json("record").alias("t")).collect())
    assert got == [(0, 0, '{"a":1}'), (1, 0, '{"a":1}'), (1, 1, '{"a":2}'), (2, 0, '{"a":3}'), (8, 0, "{}")]


def test_selectors(spark):
    r = F.col("record")
    found = _records(spark, '{"a":{"b":[1,{"c":"x"}]},"n":null,"f":1.5,"t":true,"it\'s":"q"}')
    text = lambda s: F.to_json(records.select_field(r, s))
    row = found.select(
        text("$.a.b[1].c"), text("$.a.b"), text("$.a.b[x]"), text("$.a.b[9]"), text("a.b[0]"), records.field_text(r, "$.a"), records.field_text(r, "a", containers=False),
        records.field_text(r, "n"), records.field_text(r, "f"), records.field_text(r, "t"), records.field_text(r, "it's"), records.field_text(r, "none.of"),
    ).first()
    assert tuple(row) == ('"x"', '[1,{"c":"x"}]', None, None, "1", '{"b":[1,{"c":"x"}]}', None, None, "1.5", "true", "q", None)


def test_resolved_fields(spark):
    both = _records(spark, '[{"author":"a","author_name":"b","title":"t"},{"author":null,"author_name":"c","title":"u"}]')
    assert records.resolve_field(both, "record", records.AUTHOR) == "$.author_name"
    assert records.resolve_field(both, "record", records.MESSAGE) == "$.title"
    assert records.resolve_field(both.where("false"), "record", records.AUTHOR) == "$.author"


def test_time_fields(spark):
    assert records.time_field(_records(spark, '{"Update":"no","created_at":1700000000,"z_date":"2024-01-01"}'), "record") == "$.created_at"
    assert records.time_field(_records(spark, '{"day":"2024-01-01","date":true,"time":5}'), "record") is None
    assert records.time_field(_records(spark, "[]"), "record") is None
    row = _records(spark, '{"a":"2025-06-15T12:00:00+02:00","b":946684799,"c":4102444800,"d":"1700000000","e":1700000000.7}')
    got = row.select(*[records.to_epoch(records.select_field(F.col("record"), k)) for k in "abcde"]).first()
    assert tuple(got) == (1749981600, None, 4102444800, None, 1700000000)
