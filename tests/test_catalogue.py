"""Every query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest
from compare import frame
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
        a, b = frame(got), frame(want)
        assert list(a.columns) == list(b.columns)
        assert a.equals(b)


def test_stream_agrees_with_batch(spark):
    q = catalogue.queries()
    stream = {r.node: r.last_seen for r in q["stream_member_state"](spark, SF).collect()}
    batch = {r.node: r.last_seen for r in q["member_state"](spark, SF).collect()}
    assert stream.keys() == batch.keys()


def test_entry_has_every_query_and_sql_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_transfer_plan_invariants(spark):
    rows = catalogue.queries()["transfer_plan"](spark, SF).collect()
    load, plans = {}, {}
    for r in rows:
        load[r.node, r.peer] = load.get((r.node, r.peer), 0) + 1
        plans[r.node] = plans.get(r.node, 0) + 1
        assert r.node != r.peer and r.rarity >= 1
    assert max(load.values()) <= 4 and max(plans.values()) <= 16
    assert len({(r.node, r.hash) for r in rows}) == len(rows)


def test_every_node_observes_its_peers(spark):
    from tessera.sources import cluster

    sf = "/root/testdata/sf0.01"  # over twelve nodes
    n = cluster.nodes(spark, sf).count()
    rows = catalogue.queries()["peer_proximity"](spark, sf).collect()
    assert len(rows) == n * (n - 1) and len({r.observer for r in rows}) == n
