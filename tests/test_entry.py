import pytest

import __spark_entry__ as entry
from ferrule.queries import ORACLE_SQL, QUERIES


def test_every_engine_query_is_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", ["fraud_orders", "multi_rule_long", "gc_stats", "profile_diff"])
def test_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    mine = QUERIES[name](spark, d).toPandas()
    theirs = con.sql(ORACLE_SQL[name]).df()[list(mine.columns)]
    show = lambda f: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r).__repr__().replace("nan", "None") for r in f.itertuples(index=False))
    assert show(mine) == show(theirs)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
