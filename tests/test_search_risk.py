import datetime as dt

import pytest
from pyspark.sql import functions as F

from tendergrid.operators import risk, rollups, search
from tendergrid.operators.predicates import ContractFilter, lookback, updated_since
from tendergrid.operators.skew import attach_key_figures
from tendergrid.sources import order_tables

COLUMNS = (
    "id_contrato string, nombre_entidad string, nit_entidad string, proveedor_adjudicado string, "
    "documento_proveedor string, valor_contrato double, fecha_firma date, estado_contrato string, "
    "modalidad_contratacion string, proceso_de_compra string, anio int"
)


def contract(key, supplier="S", value=1.0, day=dt.date(2024, 1, 1), entity="E", doc=None):
    return (key, entity, "9", supplier, doc or supplier, value, day, "x", "m", "p" + key, day.year if day else 0)


@pytest.fixture(scope="module")
def contracts(spark, tables):
    return order_tables.contracts(spark, tables).cache()


def ids(rows):
    return [r["id_contrato"] for r in rows.collect()]


def test_pages_cover_everything_once(contracts):
    total = search.contract_count(contracts, ContractFilter(), 200).first()
    numbered = [ids(search.contracts_page(contracts, ContractFilter(), p, 200)) for p in range(1, total["total_pages"] + 2)]
    flat = sum(numbered, [])
    assert len(flat) == len(set(flat)) == total["total"] == contracts.count()
    assert numbered[-1] == []
    followed, last = [], None
    page = search.contracts_page(contracts, ContractFilter(), 1, 200).collect()
    while page:
        followed += [r["id_contrato"] for r in page]
        last = page[-1]
        page = search.contracts_page_after(contracts, ContractFilter(), last["fecha_firma"], last["id_contrato"], 200).collect()
    assert followed == flat


@pytest.mark.parametrize("page, size", [(0, 50), (1, 0), (1, 201)])
def test_page_limits(contracts, page, size):
    with pytest.raises(ValueError):
        search.contracts_page(contracts, ContractFilter(), page, size)


def test_filters(spark):
    rows = spark.createDataFrame(
        [contract("1", value=0.0, entity="ÁRBOL 100%"), contract("2", value=5.0, entity="a\\b"), contract("3", value=None)], COLUMNS
    )
    keys = lambda **f: set(ids(ContractFilter(**f).apply(rows)))
    assert keys() == keys(entidad="") == {"1", "2", "3"}
    assert keys(valor_max=0.0) == {"1"} and keys(valor_min=0) == {"1", "2"}
    assert keys(entidad="árb") == {"1"} and keys(entidad="arb") == set()
    assert keys(entidad="a\\b") == {"2"} and keys(entidad="9") == {"1", "2", "3"}
    assert keys(anio=2023) == set() and keys(fecha_desde=dt.date(2024, 1, 1)) == {"1", "2", "3"}
    assert keys(fecha_hasta=dt.date(2023, 12, 31)) == set()


def test_lookback():
    assert lookback("2026-07-15T10:00:00.000") == "2026-07-08T00:00:00.000"
    assert lookback("bad") == "bad" and lookback(None) is None


def test_updated_since(spark):
    rows = spark.createDataFrame([("a", "2024-01-01T00:00:00.000"), ("b", "2024-01-09T00:00:00.000"), ("c", None)], "id_contrato string, ultima_actualizacion string")
    assert ids(updated_since(rows, "2024-01-10T00:00:00.000")) == ["b"]
    assert len(ids(updated_since(rows, None))) == 3


def test_lookups(contracts):
    assert search.recent_contracts(contracts, "nit_entidad", "none").isEmpty()
    assert rollups.entity_detail(contracts, "none").isEmpty()
    assert rollups.supplier_detail(contracts, "none").isEmpty()
    one = search.recent_contracts(contracts, "nit_entidad", "3")
    every = search.recent_contracts_all(contracts, "nit_entidad").where("nit_entidad = '3'").orderBy("puesto")
    assert ids(one) == ids(every)


def test_empty_input_gives_zeros(spark):
    none = spark.createDataFrame([], COLUMNS + ", localizacion string, valor_pagado double, ultima_actualizacion string")
    assert tuple(rollups.kpi(none).first()) == (0, 0.0, 0.0, 0, 0, 0)
    assert tuple(rollups.year_range(none).first()) == (0, 0)
    assert tuple(rollups.total_values(none).first()) == (0.0, 0.0)
    assert tuple(search.contract_count(none, ContractFilter()).first()) == (0, 0)


def test_lists_and_counts_agree(contracts):
    for text in (None, "1"):
        assert rollups.entity_count(contracts, text).first()[0] == rollups.entity_list(contracts, text).count()
        assert rollups.supplier_count(contracts, text).first()[0] == rollups.supplier_list(contracts, text).count()


def test_sums_do_not_depend_on_the_layout(contracts):
    totals = {rollups.kpi(contracts.repartition(n)).first() for n in (1, 3, 16)}
    assert len(totals) == 1


def test_risk_levels(spark):
    rows = [contract(f"n{i}", "many", 1.0) for i in range(11)] + [contract("big", "many", 1000.0)]
    rows += [contract("z1", "zero", 5.0), contract("z2", "zero", -5.0), contract("q", None, 9.0), contract("few", "few", None)]
    found = {r["id_contrato"]: r for r in risk.risk_contracts(spark.createDataFrame(rows, COLUMNS), 10, 5).collect()}
    assert set(found) == {f"n{i}" for i in range(11)} | {"big", "z1"}
    assert found["big"]["nivel_riesgo"] == "alto" and found["n0"]["nivel_riesgo"] == "medio"
    assert found["big"]["indicadores"] == ["Alta concentración: 12 contratos", risk.OUTLIER_TEXT]
    assert found["z1"]["nivel_riesgo"] == "bajo" and found["z1"]["indicadores"] == []
    with pytest.raises(ValueError):
        risk.risk_contracts(spark.createDataFrame(rows, COLUMNS), 0, 5)


@pytest.mark.parametrize("hot", [{}, {"hot_share": 0.01, "hot_rows": 1}, {"hot_share": 0.2, "hot_rows": 1}])
def test_hot_supplier(spark, hot):
    """A supplier with a third of all contracts gives the same rows, cut into pieces or not."""
    rows = [contract(f"h{i}", "hot", float(i)) for i in range(300)]
    rows += [contract(f"c{i}", f"s{i % 60}", float(i)) for i in range(600)] + [contract("q", None)]
    frame = spark.createDataFrame(rows, COLUMNS)
    joined = risk.contractor_stats_join(frame, **hot)
    expected = {}
    for r in rows:
        expected.setdefault(r[3], []).append(r[5])
    result = joined.collect()
    assert len(result) == len({r["id_contrato"] for r in result}) == 900
    for r in result:
        values = expected[r["proveedor_adjudicado"]]
        assert r[risk.COUNT] == len(values) and r[risk.MEAN] == sum(values) / len(values)


def test_hot_key_is_really_cut(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    figures = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = attach_key_figures(rows, figures, "k", "n", "id", hot_share=0.05, hot_rows=1)
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "_piece" in plan


def test_unpaid(spark):
    rows = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), None), ("b", dt.date(2020, 1, 1), 5.0), ("c", dt.date(2021, 6, 30), 0.0), ("d", None, None)],
        "id_contrato string, fecha_firma date, valor_pagado double",
    )
    assert ids(rollups.unpaid_over_12_months(rows, dt.date(2022, 6, 30))) == ["a"]
