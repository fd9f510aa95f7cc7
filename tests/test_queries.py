"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from strandloom.plans import catalogue


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if hasattr(v, "is_finite") else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted(str(tuple(_plain(x) for x in r)) for r in got.select(*columns).collect())
    if name not in catalogue.ORACLE_SQL:
        assert mine
        return
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = c.sql(f"SELECT * FROM ({catalogue.ORACLE_SQL[name]})")
    assert sorted(found.columns) == columns
    assert mine == sorted(str(tuple(_plain(x) for x in r)) for r in found.select(*[f'"{k}"' for k in columns]).fetchall())


def test_anchors_of_the_recruit(spark, sf):
    got = catalogue.QUERIES["recruit_supersteps"](spark, sf).orderBy("superstep").collect()
    assert [r["n_total"] for r in got] == [3, 18, 32, 35]
