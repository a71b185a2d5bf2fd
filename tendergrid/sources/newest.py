"""Pages and newest-first lists over stored years that open only the years they show.

Contracts are ordered by signing date, so the years are too; contracts without a
date are in year 0, which comes last. Whole years before a page are passed over
by their number of rows, and years after it are never opened.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators.predicates import ContractFilter, years_in
from ..schemas import YEAR
from . import lake, versions

# Fixed value: the year of contracts without a signing date.
UNDATED = 0


def years_of_page(
    years: list[int], count: Callable[[list[int]], dict[int, int]], offset: int, size: int
) -> tuple[list[int], int]:
    """The years with rows offset + 1 to offset + size, and how many rows of these years to pass over.

    count gives the rows of some years. It is asked for the newest year first,
    then for twice as many each time, until the page is full.
    """
    ordered = sorted(set(years), key=lambda year: (year == UNDATED, -year))
    taken, held, at, step = [], 0, 0, 1
    while at < len(ordered):
        group = ordered[at : at + step]
        rows = count(group)
        for year in group:
            here = rows.get(year, 0)
            if not taken and here <= offset:
                offset -= here
            elif here:
                taken.append(year)
                held += here
            if held >= offset + size:
                return taken, offset
        at, step = at + step, step * 2
    return taken, offset


def _counted(rows: DataFrame) -> Callable[[list[int]], dict[int, int]]:
    """Rows of some years by a job over those years' partitions; one row per year comes back."""

    def count(years: list[int]) -> dict[int, int]:
        per_year = rows.where(years_in(years)).groupBy(YEAR).count()
        return {row[YEAR]: row["count"] for row in per_year.collect()}

    return count


def gold_page(
    spark: SparkSession, root: str, filters: ContractFilter, page: int = 1, size: int = search.PAGE_SIZE
) -> DataFrame:
    """search.contracts_page over the stored years.

    Without filters, or by year alone, the rows of the years are known from the
    manifest. Any other filter is counted year by year until the page is full,
    on the columns it names.
    """
    offset = search.page_offset(page, size)
    version = versions.current(spark, root)
    stored = lake.year_counts(spark, root, version=version)
    rows = filters.apply(lake.gold_scan(spark, root, version))
    years = filters.years(list(stored))
    count = _counted(rows) if filters.needs_rows() else lambda group: {year: stored[year] for year in group}
    taken, offset = years_of_page(years, count, offset, size)
    return search.newest(rows.where(years_in(taken)), offset, size)


def gold_recent(
    spark: SparkSession, root: str, by: str, value: str, limit: int = search.RECENT
) -> DataFrame:
    """search.recent_contracts from the newest years that hold the value, and there from its files only."""
    version = versions.current(spark, root)
    files = lake.files_holding(spark, root, by, value, version)
    if files is None:
        return search.recent_contracts(lake.gold_scan(spark, root, version), by, value, limit)

    def held(years: list[int]) -> DataFrame:
        names = sorted(name for year in years for name in files[year])
        return versions.scan(spark, root, lake.GOLD, version, names).where(F.col(by) == value)

    taken, _ = years_of_page(list(files), lambda group: _counted(held(group))(group), 0, limit)
    return search.recent_contracts(held(taken), by, value, limit)
