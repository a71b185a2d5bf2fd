"""Marts kept by difference equal marts built anew, whatever comes and goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tendergrid import catalog
from tendergrid.plans import loads, mart_changes, marts
from tendergrid.plans.loads import Lake
from tendergrid.plans.mart_changes import PART
from tendergrid.sources import lake, order_tables, versions

SCHEMA = (
    "nit_entidad string, nombre_entidad string, documento_proveedor string, proveedor_adjudicado string, "
    "modalidad_contratacion string, fecha_firma date, valor_contrato double, anio int"
)


def drawn(chance):
    """A contract of few groups, so that batches hit the same ones; any column may be missing."""
    def perhaps(value):
        return None if chance.random() < 0.1 else value

    day = dt.date(chance.choice([2019, 2020, 2021]), chance.randint(1, 3), 5)
    entity, supplier = chance.randint(1, 4), chance.randint(1, 6)
    return (
        perhaps(str(entity)), perhaps(f"Entidad {entity} {chance.choice('aá')}"), perhaps(f"s{supplier}"),
        perhaps(f"Taller {supplier} {chance.choice('xy')}"), perhaps(chance.choice(["Concurso", "Subasta"])),
        day, perhaps(chance.choice([0.0, 10.25, 99.99, 5e9, float(chance.randint(1, 400))])), day.year,
    )


def frame(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA).repartition(3)


def same(one, other):
    other = other.select(*one.columns)
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


@pytest.mark.parametrize("mart", marts.MARTS, ids=lambda mart: mart.name)
def test_random_batches(spark, tmp_path, monkeypatch, mart):
    monkeypatch.setattr(mart_changes, "MOST_PARTS", 2)
    chance, root = random.Random(mart.name), str(tmp_path)
    held = [drawn(chance) for _ in range(60)]
    marts.mart_start(mart, frame(spark, held), root)
    for step in range(3):
        # The last batch empties a year: its groups and its part of the mart go.
        gone = [row for row in held if row[7] == 2020] if step == 2 else chance.sample(held, 15)
        for row in gone:
            held.remove(row)
        # Moved to another year, copied, and new.
        come = [] if step == 2 else [(*row[:5], row[5].replace(year=2021), row[6], 2021) for row in gone[:4]] + gone[4:6] + [drawn(chance) for _ in range(6)]
        held += come
        changes = mart_changes.weighted(frame(spark, gone), frame(spark, come))
        rows = marts.mart_change(mart, changes, root)
        stored = versions.scan(spark, root, mart.name)
        assert same(mart.build(frame(spark, held)), stored) and rows == stored.count()
        state = versions.scan(spark, root, mart.name + lake.STATE)
        assert state.select(PART).distinct().count() <= 2
        assert same(mart_changes.added_up(state), mart_changes.counted(mart.name, frame(spark, held)))


def test_no_changes_and_changes_that_cancel_out(spark, tmp_path):
    chance, root, mart = random.Random(3), str(tmp_path), marts.MART["mart_modalidades"]
    rows = frame(spark, [drawn(chance) for _ in range(20)])
    marts.mart_start(mart, rows, root)
    before = versions.scan(spark, root, mart.name).collect()
    for changes in (mart_changes.weighted(rows.limit(0), rows.limit(0)), mart_changes.weighted(rows, rows)):
        assert marts.mart_change(mart, changes, root) == len(before)
        assert sorted(map(str, versions.scan(spark, root, mart.name).collect())) == sorted(map(str, before))
    assert mart_changes.changes_between(rows, rows).isEmpty()


def test_changes_of_rows_that_were_never_there_stop(spark, tmp_path):
    chance, root, mart = random.Random(4), str(tmp_path), marts.MART["mart_entidades"]
    rows = frame(spark, [drawn(chance) for _ in range(20)])
    marts.mart_start(mart, rows, root)
    alien = rows.where("nit_entidad IS NOT NULL").withColumn("nit_entidad", F.lit("77")).fillna("x")
    with pytest.raises(Exception, match="out of range"):
        marts.mart_change(mart, mart_changes.weighted(alien, rows.limit(0)), root)
    assert same(mart.build(rows), versions.scan(spark, root, mart.name))


def test_batches_of_a_lake(spark, tables, tmp_path, monkeypatch):
    """The first batch builds the state; from the second on no mart is built from contracts."""
    target = Lake(str(tmp_path / "lake"))
    days = [dt.date(1997, 6, 30), dt.date(1998, 6, 30), None]
    loads.load_full(spark, order_tables.page_rows(spark, tables, days[0]), target)
    state = f"mart_temporal{lake.STATE}"
    assert versions.scan(spark, target.root, state) is None
    for number, (last, day) in enumerate(zip(days, days[1:], strict=False)):
        with monkeypatch.context() as patch:
            if number:
                patch.setattr(marts, "_put_from", lambda *_: pytest.fail("built from contracts"))
            since = (last + dt.timedelta(days=1)).isoformat()
            summary = loads.load_batch(spark, order_tables.page_rows(spark, tables, day), target, since)
        assert summary["updated_records"] + summary["inserted_records"] > 0
        for mart in marts.MARTS:
            assert same(mart.build(target.scan(spark, lake.GOLD)), target.scan(spark, mart.name)), mart.name
            assert summary["marts"][mart.name] == target.scan(spark, mart.name).count()
    assert target.scan(spark, state).select(PART).distinct().count() == 2
    # Contracts replaced in another way: the counts would no longer fit.
    lake.gold_write_full(target.scan(spark, lake.GOLD), target.root)
    assert target.scan(spark, state) is None


@pytest.mark.parametrize("mart", marts.MARTS, ids=lambda mart: mart.name)
def test_registered_differences_read_only_what_the_mart_needs(spark, tables, monkeypatch, mart):
    """Changes go to the counts as they are, without the columns of other marts and without a grouping by whole contracts."""
    seen = []
    monkeypatch.setattr(marts, "mart_change", lambda mart, changes, root: seen.append(changes))
    monkeypatch.setattr(marts, "mart_start", lambda mart, before, root: before.limit(0).createOrReplaceTempView(mart.name))
    catalog.QUERIES[f"{mart.name}_difference"](spark, tables)
    assert set(seen[0].columns) == {*catalog.MART_NEEDS[mart.name], mart_changes.WEIGHT}
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    whole = mart_changes.weighted(*[catalog._mart_rows(spark, tables, until=until) for until in (catalog.SNAPSHOT, None)])
    assert same(mart_changes.counted(mart.name, whole), mart_changes.counted(mart.name, seen[0]))


def test_few_touched_groups_are_joined_without_a_shuffle(spark, tmp_path, monkeypatch):
    chance, mart, hinted = random.Random(5), marts.MART["mart_entidades"], []
    rows, more = (frame(spark, [drawn(chance) for _ in range(20)]) for _ in range(2))
    broadcast = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda found: hinted.append(found.columns) or broadcast(found))
    for few in (100, 0):
        monkeypatch.setattr(mart_changes, "FEW_GROUPS", few)
        root = str(tmp_path / str(few))
        marts.mart_start(mart, rows, root)
        marts.mart_change(mart, mart_changes.weighted(rows.limit(0), more), root)
        assert same(mart.build(rows.unionByName(more)), versions.scan(spark, root, mart.name))
        assert (["anio", "grupo"] in hinted) == (few > 0)
        hinted.clear()


@pytest.mark.parametrize("name", ["mart_entidades_incremental", "mart_proveedores_incremental", "mart_entidades_difference"])
def test_incremental_marts_store_no_contracts(spark, tables, tmp_path, name):
    """They need no line items, so a folder without them does."""
    for table in ("orders", "customer", "nation", "region"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{tables}/{table}.parquet")
    got, whole = (catalog.QUERIES[name](spark, folder).collect() for folder in (str(tmp_path), tables))
    assert len(got) > 0 and sorted(map(str, got)) == sorted(map(str, whole))
