"""Contract search: projections, lookups, pages and newest-first lists."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DETAIL_COLUMNS, KEY, SUMMARY_COLUMNS, YEAR
from . import rollups
from .predicates import ContractFilter

# Sizes of pages and lists.
PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
RECENT = 10


def _newest_first():
    return F.col("fecha_firma").desc_nulls_last(), F.col(KEY).asc_nulls_last()


def contract_summary(contracts: DataFrame) -> DataFrame:
    return contracts.select(*SUMMARY_COLUMNS)


def contract_detail(contracts: DataFrame) -> DataFrame:
    return contracts.select(*DETAIL_COLUMNS).withColumn(
        "dias_adicionados", F.col("dias_adicionados").try_cast("int")
    )


def lookup_contract(contracts: DataFrame, key: str) -> DataFrame:
    return contract_detail(contracts.where(F.col(KEY) == key))


def page_offset(page: int, size: int) -> int:
    """Rows before a page."""
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page starts at 1, page size is 1 to {MAX_PAGE_SIZE}")
    return (page - 1) * size


def newest(contracts: DataFrame, offset: int, size: int) -> DataFrame:
    """Summaries newest first, `size` of them after the first `offset`."""
    return contract_summary(contracts).orderBy(*_newest_first()).offset(offset).limit(size)


def contracts_page(
    contracts: DataFrame, filters: ContractFilter, page: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """One page by number. Costs more the deeper the page is; over stored years see sources/newest.py."""
    return newest(filters.apply(contracts), page_offset(page, size), size)


def contracts_page_after(
    contracts: DataFrame,
    filters: ContractFilter,
    last_date: dt.date | None,
    last_key: str,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """The page that follows a known last row, without sorting what came before it.

    Where contracts have their year, newer years are not opened.
    """
    page_offset(1, size)
    signed, key = F.col("fecha_firma"), F.col(KEY)
    if last_date is None:
        later = signed.isNull() & (key > last_key)
    else:
        day = F.lit(last_date)
        later = (signed < day) | ((signed == day) & (key > last_key)) | signed.isNull()
    if YEAR in contracts.columns:
        # Contracts without a date are in year 0.
        contracts = contracts.where(F.col(YEAR) <= (0 if last_date is None else last_date.year))
    rows = contract_summary(filters.apply(contracts).where(later))
    return rows.orderBy(*_newest_first()).limit(size)


def contract_count(
    contracts: DataFrame, filters: ContractFilter, size: int = PAGE_SIZE
) -> DataFrame:
    total = F.count(F.lit(1))
    return filters.apply(contracts).agg(
        total.alias("total"), F.ceil(total / F.lit(size)).cast("bigint").alias("total_pages")
    )


def _page_by_value(rollup: DataFrame, key: str, page: int, size: int) -> DataFrame:
    ordered = rollup.orderBy(F.col("valor_total").desc_nulls_last(), F.col(key).asc_nulls_last())
    return ordered.offset(page_offset(page, size)).limit(size)


def entity_page(
    contracts: DataFrame, search: str | None = None, page: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    return _page_by_value(rollups.entity_list(contracts, search), "nit_entidad", page, size)


def supplier_page(
    contracts: DataFrame, search: str | None = None, page: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    return _page_by_value(
        rollups.supplier_list(contracts, search), "documento_proveedor", page, size
    )


def recent_contracts(
    contracts: DataFrame, by: str, value: str, limit: int = RECENT
) -> DataFrame:
    """Newest contracts of one entity (by nit_entidad) or supplier (by documento_proveedor)."""
    return (
        contract_summary(contracts.where(F.col(by) == value))
        .orderBy(*_newest_first())
        .limit(limit)
    )


def recent_contracts_all(contracts: DataFrame, by: str, limit: int = RECENT) -> DataFrame:
    """Newest contracts of every entity or supplier in one job.

    Map tasks keep only the newest `limit` rows of a group before the shuffle.
    """
    order = Window.partitionBy(by).orderBy(*_newest_first())
    columns = [by] + [name for name in SUMMARY_COLUMNS if name != by]
    return (
        contracts.where(F.col(by).isNotNull())
        .select(*columns)
        .withColumn("puesto", F.row_number().over(order).cast("bigint"))
        .where(F.col("puesto") <= limit)
    )
