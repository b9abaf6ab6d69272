import math

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from pathlode.plans import catalogue  # noqa: E402


def test_flagship(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = db.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == columns
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v for v in r)) for r in rows)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)
