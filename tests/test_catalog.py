"""All queries with SQL give the SQL's rows on the small tables."""

import datetime
import math
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from lorekeep.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings records messages sessions workspaces entities session_exports record_feeds eval_items".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    import duckdb

    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
        found = db.sql(sql)
        at = [list(found.columns).index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_oracles_name_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
