"""Pages over stored years: the rows of the plain page, from no more years than it shows."""

import datetime as dt
import re

import pytest

from tendergrid.operators import search
from tendergrid.operators.predicates import ContractFilter
from tendergrid.schemas import SUMMARY_COLUMNS
from tendergrid.sources import lake, newest

YEARS = [0, 2018, 2019, 2021, 2022, 2023, 2024]
SCHEMA = "id_contrato string, anio int, fecha_firma date, nombre_entidad string, nit_entidad string, documento_proveedor string, valor_contrato double"


def row(i):
    year = YEARS[(i * 3 + i // 11) % len(YEARS)]
    day = dt.date(year, 1 + i % 12, 1 + i % 3) if year else None
    return (f"c{i:03}", year, day, f"Entity {i % 5}", str(i % 5), str(i % 40), float(i))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("years"))
    rows = spark.createDataFrame([row(i) for i in range(230)], SCHEMA)
    for name in SUMMARY_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, rows["nombre_entidad"])
    lake.gold_write_full(rows, root)
    return root


def years_of(rows):
    """Years the plan opens."""
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    found = re.findall(r"anio#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    return sorted(int(y) for several, one in found for y in (several or one).split(","))


@pytest.mark.parametrize(
    "filters",
    [ContractFilter(), ContractFilter(anio=2022), ContractFilter(entidad="entity 3"), ContractFilter(fecha_desde=dt.date(2019, 5, 1), valor_max=150.0),
     ContractFilter(anio=1990), ContractFilter(valor_min=1e9)],
)
def test_pages_equal_the_plain_ones(spark, stored, filters):
    contracts = lake.gold_scan(spark, stored)
    whole = search.newest(filters.apply(contracts), 0, 1000).collect()
    found = []
    for page in range(1, len(whole) // 60 + 3):
        found += newest.gold_page(spark, stored, filters, page, 60).collect()
    assert found == whole


def test_a_page_opens_only_its_years(spark, stored):
    counts = lake.year_counts(spark, stored)
    assert years_of(newest.gold_page(spark, stored, ContractFilter(), 1, 5)) == [2024]
    deep = newest.gold_page(spark, stored, ContractFilter(), sum(counts.values()) // 10, 10)
    assert 2024 not in years_of(deep)
    assert years_of(newest.gold_page(spark, stored, ContractFilter(entidad="2"), 1, 5)) == [2024]


def test_years_are_asked_for_until_the_page_is_full():
    rows, asked = {2024: 3, 2023: 0, 2022: 4, 2021: 9, 0: 2}, []

    def count(years):
        asked.append(years)
        return {year: rows[year] for year in years if rows[year]}

    assert newest.years_of_page(list(rows), count, 0, 3) == ([2024], 0) and asked == [[2024]]
    asked.clear()
    assert newest.years_of_page(list(rows), count, 4, 2) == ([2022], 1) and asked == [[2024], [2023, 2022]]
    assert newest.years_of_page(list(rows), count, 6, 6) == ([2022, 2021], 3)
    assert newest.years_of_page(list(rows), count, 16, 9) == ([0], 0)
    assert newest.years_of_page(list(rows), count, 18, 9) == ([], 0)
    assert newest.years_of_page([], count, 0, 9) == ([], 0)


@pytest.mark.parametrize("by, value", [("nit_entidad", "3"), ("documento_proveedor", "7"), ("nit_entidad", "none"), ("nombre_entidad", "Entity 1")])
def test_recent_contracts(spark, stored, by, value):
    contracts = lake.gold_scan(spark, stored)
    for limit in (1, 4, 100):
        assert newest.gold_recent(spark, stored, by, value, limit).collect() == search.recent_contracts(contracts, by, value, limit).collect()


def test_recent_contracts_open_only_the_newest_files(spark, stored):
    opened = newest.gold_recent(spark, stored, "nit_entidad", "3", 2).inputFiles()
    assert opened and all("anio=2024" in path for path in opened)


def test_the_page_after_a_row_opens_no_newer_year(spark, stored):
    contracts = lake.gold_scan(spark, stored)
    whole = search.newest(contracts, 0, 1000).collect()
    for place in (0, 90, 200, 229):
        last = whole[place]
        after = search.contracts_page_after(contracts, ContractFilter(), last["fecha_firma"], last["id_contrato"], 20)
        assert after.collect() == whole[place + 1 : place + 21]
        assert "anio" in re.search(r"PartitionFilters: \[(.*?)\]", after._jdf.queryExecution().executedPlan().toString())[1]
