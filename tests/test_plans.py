"""The shape of the physical plans over stored yearly partitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tendergrid import catalog
from tendergrid.operators import merge, risk, rollups, search
from tendergrid.operators.predicates import ContractFilter
from tendergrid.plans import marts
from tendergrid.session import table_file_size
from tendergrid.sources import lake, order_tables


@pytest.fixture(scope="module")
def gold(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "gold")
    lake.gold_write_full(order_tables.contracts(spark, tables), path)
    return lake.gold_scan(spark, path)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_year_filter_prunes_partitions(gold):
    text = plan(search.contracts_page(gold, ContractFilter(anio=1998)))
    assert "(anio" in text.split("PartitionFilters: [")[1].split("]")[0] and "TakeOrderedAndProject" in text


def test_date_range_prunes_partitions(gold):
    text = plan(ContractFilter(fecha_desde=dt.date(1997, 2, 1)).apply(gold))
    assert ">= 1997" in text.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_lookup_reaches_the_files(gold):
    assert "EqualTo(id_contrato,42)" in plan(search.lookup_contract(gold, "42"))


def test_only_needed_columns_are_read(gold):
    text = plan(rollups.top_contractors(gold))
    assert text.split("ReadSchema: ")[1].startswith("struct<valor_contrato:double,proveedor_adjudicado:string>")


@pytest.mark.parametrize(
    "rows",
    [lambda g: search.recent_contracts_all(g, "nit_entidad"), rollups.entity_top_suppliers],
)
def test_rank_limit_comes_before_the_shuffle(gold, rows):
    text = plan(rows(gold))
    assert text.index("Final") < text.index("Exchange hashpartitioning(nit_entidad") < text.index("Partial")


def test_no_python_and_no_cross_join(gold):
    for rows in (risk.risk_contracts(gold), rollups.kpi(gold), marts.mart_modalidades(gold), marts.mart_entidades(gold)):
        text = plan(rows)
        for word in ("Python", "Cartesian", "NestedLoop"):
            assert word not in text


def test_text_maxima_sort_only_added_up_rows(gold):
    text = plan(rollups.supplier_list(gold))
    assert text.rstrip().rindex("HashAggregate") > text.rindex("SortAggregate")


def test_entity_names_are_sorted_only_as_distinct_names(gold):
    text = plan(marts.mart_entidades(gold))
    names, figures = text.split("FileScan")[:2]
    # Going up from the scan: hashed per distinct name, sorted after the shuffle only.
    below = names[names.rindex("Exchange") :]
    assert "HashAggregate" in below and "SortAggregate" not in below and "SortAggregate" not in figures


def test_a_hot_year_becomes_several_files(spark, tmp_path):
    """REBALANCE cuts a year that is too large for one file."""
    rows = spark.range(0, 400_000, 1, 8).selectExpr(
        "cast(id as string) id_contrato", "sha2(cast(id as string), 256) texto",
        "if(id % 100 = 0, 2001 + cast(id % 3 as int), 2000) anio",
    )
    with table_file_size(spark, "2m"):
        lake.spread_by_year(rows).write.partitionBy("anio").parquet(str(tmp_path / "t"))
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "t").glob("anio=*")}
    assert len(files) == 4 and 4 < files["anio=2000"] <= 16


def test_merge_reads_each_side_once(spark, tmp_path):
    schema = "id_contrato string, row_hash string, anio int, ultima_actualizacion string, v double"
    for name in ("old", "new"):
        spark.createDataFrame([("a", name, 1, "1", 1.0)], schema).write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / name)) for name in ("old", "new"))
    text = plan(merge.merge_silver(old, new))
    assert text.count("FileScan") == 2


def partition_filters(text):
    return text.split("PartitionFilters: [")[1].split("PushedFilters")[0]


@pytest.mark.parametrize("name", ["filter_year", "filter_date_range", "filter_combined", "years_filter"])
def test_registered_filters_prune_stored_years(spark, tables, name):
    text = plan(catalog.QUERIES[name](spark, tables))
    assert text.count("FileScan") == 1 and "anio" in partition_filters(text)


@pytest.mark.parametrize(
    "name, column, value", [("lookup_contract", "id_contrato", "42"), ("lookup_entity", "nit_entidad", "7"), ("lookup_supplier", "documento_proveedor", "11")]
)
def test_lookups_open_only_the_files_that_hold_the_value(spark, tables, name, column, value):
    text = plan(catalog.QUERIES[name](spark, tables))
    assert text.count("FileScan") == 1 and f"EqualTo({column},{value})" in text
    root = catalog.gold_root(spark, tables)
    rows, every = lake.gold_where(spark, root, column, value), lake.gold_scan(spark, root)
    holding = {r[0].replace("file:/", "file:///") for r in every.where(F.col(column) == value).select("_metadata.file_path").distinct().collect()}
    assert set(rows.inputFiles()) == holding and rows.count() == every.where(F.col(column) == value).count()
    assert len(holding) < len(every.inputFiles()) or column != "id_contrato"
