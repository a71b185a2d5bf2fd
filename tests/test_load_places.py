"""Loads move whole rows without a shuffle: what is decided by key is found again by its place in the files."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from tendergrid.operators import merge
from tendergrid.plans import loads
from tendergrid.plans.loads import Lake
from tendergrid.schemas import KEY, UPDATED_AT, YEAR
from tendergrid.sources import lake, places

MADE = "id_contrato string, fecha_de_firma string, valor_del_contrato string, valor_pagado string, ultima_actualizacion string"


def landing(spark, first, rows, paid, day, repeat=1):
    """Contracts of several years, some of them without a date or a key, in several tasks and versions."""
    values = []
    for number in range(first, first + rows):
        key = None if number % 23 == 0 else f"C-{number}"
        signed = None if number % 17 == 0 else f"{2015 + number % 6}-03-04T00:00:00.000"
        for version in range(1 + (number % 5 == 0) * (repeat - 1)):
            values.append((key, signed, str(number), f"{paid}.{version}", f"{day}T0{version}:00:00.000"))
    return spark.createDataFrame(values, MADE).repartition(3)


@pytest.fixture
def unspread(monkeypatch):
    """As for a table of more than 64 MB."""
    spread, before = [], lake.spread_by_year
    monkeypatch.setattr(places, "SMALL", 0)
    monkeypatch.setattr(lake, "spread_by_year", lambda rows, *a: spread.append(len(rows.columns)) or before(rows, *a))
    return lambda: [columns for columns in spread if columns > 40]


FIELDS = [KEY, YEAR, "valor_contrato", "valor_pagado", UPDATED_AT]


def content(spark, target, table):
    return sorted(map(str, target.scan(spark, table).select(*FIELDS).collect()))


def expected(*landed):
    newest = {}
    for rows in landed:
        for row in rows.collect():
            known = newest.get(row[0])
            if row[0] is not None and (known is None or row[4] > known[4]):
                newest[row[0]] = row
    return len(newest), sorted((key, float(row[3]), row[4]) for key, row in newest.items())


def figures(spark, target, table):
    return sorted(map(tuple, target.scan(spark, table).select(KEY, "valor_pagado", UPDATED_AT).collect()))


@pytest.mark.parametrize("most", [places.MOST_MARKS, 0])
def test_loads_from_places_keep_the_newest_version_of_each_key(spark, tmp_path, unspread, monkeypatch, most):
    monkeypatch.setattr(places, "MOST_MARKS", most)
    target = Lake(str(tmp_path / "lake"))
    first = landing(spark, 0, 300, 1, "2021-01-01", repeat=3)
    loads.load_full(spark, first, target)
    rows, newest = expected(first)
    assert len(content(spark, target, "silver")) == rows and figures(spark, target, "silver") == newest
    second = landing(spark, 150, 300, 2, "2021-02-01", repeat=4)
    stale = landing(spark, 0, 100, 3, "2020-12-01")
    summary = loads.load_batch(spark, second.unionByName(stale), target)
    rows, newest = expected(first, second, stale)
    assert figures(spark, target, "silver") == newest and figures(spark, target, "gold") == newest
    assert content(spark, target, "silver") == content(spark, target, "gold")
    assert summary["silver_records"] == rows and summary["updated_records"] == sum(1 for n in range(150, 300) if n % 23)
    assert summary["stale_records"] == sum(1 for n in range(100) if n % 23)
    assert target.scan(spark, "rejected").count() == sum(1 for rows in (first, second, stale) for row in rows.collect() if row[0] is None)
    # With too many marks a shuffle by year follows the join.
    assert bool(unspread()) == (most == 0)


def test_a_place_is_marked_alone(spark, tmp_path):
    """Numbers at the ends of bytes and blocks, in files of two years."""
    rows = spark.range(140_000).select(F.col("id").cast("string").alias(KEY), (F.col("id") % 2 + 2020).cast("int").alias(YEAR))
    table = places.stored(rows.coalesce(1), str(tmp_path / "rows"))
    wanted = {0, 1, 7, 8, 15, 16, 65_535, 65_536, 65_537, 131_071, 139_999}
    marks = table.marks(table.placed(KEY).where(F.col(KEY).isin([str(n) for n in wanted])))
    assert {int(row[0]) for row in places.at(table.rows(), marks).select(KEY).collect()} == wanted
    kept = merge.keep_unreplaced(table.rows([2021]), marks, places.marked())
    assert kept.count() == 70_000 - sum(n % 2 for n in wanted)


def test_whole_rows_of_a_load_are_not_shuffled(spark, tmp_path, unspread, monkeypatch):
    """Only narrow rows meet by key, and each year is read and written by itself."""
    widths, stored = [], lake.put_silver

    def put(made, rows, years=None, spread=True):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        widths.append(plan.count("Exchange hashpartitioning") + plan.count("REBALANCE"))
        return stored(made, rows, years, spread)

    monkeypatch.setattr(lake, "put_silver", put)
    target = Lake(str(tmp_path / "lake"))
    loads.load_full(spark, landing(spark, 0, 200, 1, "2021-01-01", repeat=2), target)
    loads.load_batch(spark, landing(spark, 100, 200, 2, "2021-02-01"), target)
    assert widths == [0, 0] and not unspread()
    manifest = sorted(glob.glob(f"{target.root}/_manifests/*.json"))[-1]
    parts = json.load(open(manifest))["tables"]["silver"]["parts"]
    # One file of rows that stayed and one of those that came.
    assert len(parts) == 7 and all(part["files"] <= 2 for part in parts.values())
