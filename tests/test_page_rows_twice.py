"""Landing rows of two days from one pass over orders and lines: the rows of page_rows, and one scan of the lines."""

import datetime as dt

import pytest

from tendergrid import catalog
from tendergrid.sources import order_tables

DAY = dt.date(1999, 12, 31)
BEFORE, ON, AFTER = dt.datetime(1999, 3, 1), dt.datetime(1999, 12, 31, 23, 0), dt.datetime(2000, 2, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = str(tmp_path_factory.mktemp("orders"))
    rows = {
        "orders": (
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double",
            [
                (1, 7, "O", "1-URGENT", BEFORE, 10.5), (2, 7, "P", "5-LOW", ON, 20.0), (3, 8, "F", "3-MEDIUM", AFTER, 30.25),
                (4, None, "F", "2-HIGH", BEFORE, None), (5, 9, "O", "2-HIGH", None, 5.0), (None, 8, None, None, BEFORE, 1.0), (1, 8, "O", "2-HIGH", AFTER, 2.0),
            ],
        ),
        "lineitem": (
            "l_orderkey long, l_extendedprice double, l_discount double, l_linestatus string, l_shipdate timestamp_ntz",
            [
                (1, 100.005, 0.05, "F", BEFORE), (1, 50.0, 0.1, "F", AFTER), (1, 50.0, 0.1, "F", AFTER), (1, 7.0, None, "F", ON), (2, 9.99, 0.0, "O", ON),
                (3, 1.0, 0.5, "F", AFTER), (4, None, 0.5, "F", BEFORE), (4, 3.0, 0.5, None, None), (None, 8.0, 0.1, "F", BEFORE), (5, 8.0, 0.1, "F", AFTER),
            ],
        ),
        "customer": (
            "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, c_nationkey long",
            [(7, "n7", 10.0, "HOUSEHOLD", 0), (8, None, -900.0, "BUILDING", 24), (8, "twice", 5000.0, None, None), (None, "none", 1.0, "X", 0)],
        ),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "N0", 0), (24, "N24", 1)]),
        "region": ("r_regionkey long, r_name string", [(0, "R0")]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{made}/{name}.parquet")
    return made


def test_both_states_have_the_rows_of_page_rows(spark, folder, tmp_path):
    earlier, today = order_tables.page_rows_twice(spark, folder, DAY, str(tmp_path / "orders"))
    for found, expected in ((earlier, order_tables.page_rows(spark, folder, DAY)), (today, order_tables.page_rows(spark, folder))):
        assert found.schema == expected.schema and found.count() == expected.count() > 0
        assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0


def test_union_all_reads_the_lines_once(spark, folder, monkeypatch):
    read, table = [], order_tables._table
    monkeypatch.setattr(order_tables, "_table", lambda spark, folder, name: (read.append(name), table(spark, folder, name))[1])
    assert catalog.QUERIES["union_all"](spark, folder).count() > 0
    assert read.count("lineitem") == read.count("customer") == 1
