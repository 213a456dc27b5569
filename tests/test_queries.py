"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from porelith import catalog as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def same(spark, con, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(con.sql(sql).columns)
    assert plain(map(tuple, df.select(*cols).collect())) == plain(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Tables without a returned line item, so all voxels of the line grid are pore and those of the sparse grid 0, and with events beyond the bins."""
    folder = tmp_path_factory.mktemp("odd")
    items = [(float(k % 50 + 1), k % 11 / 100, k % 9 / 100, "N", "FO"[k % 2]) for k in range(300)]
    events = [(v,) for v in (0.0, 3.0, 3.5, 499.99, 500.0, 560.21, 1e6, -0.5, -30.0, None, None)]
    spark.createDataFrame(items, "l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(str(folder / "lineitem.parquet"))
    spark.createDataFrame(events, "value double").selectExpr("timestamp'2024-01-01' AS ts", "value").coalesce(1).write.parquet(str(folder / "events.parquet"))
    return str(folder)


ODD_QUERIES = ["phase_saturation", "event_bins_streamed", "plane_closing_functions", "closing_functions", "plane_opening_functions", "opening_functions", "squared_distances", "squared_distances_by_joins", "squared_distances_periodic"]


@pytest.mark.parametrize("name", ODD_QUERIES)
def test_query_equals_sql_on_odd_tables(spark, odd_tables, name):
    def exact(rows):  # NaN is like NaN
        return sorted(repr(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)

    df = queries.QUERIES[name](spark, odd_tables)
    cols = sorted(df.columns)
    with duckdb.connect() as con:
        for t in ("lineitem", "events"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd_tables}/{t}.parquet/*.parquet'")
        wanted = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert exact(map(tuple, df.select(*cols).collect())) == exact(wanted)


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50 * 11 * 9
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
