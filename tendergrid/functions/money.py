"""Sums of money that do not depend on the order of the rows.

Doubles are added as DECIMAL(28,2), so a total is the same for every way the
rows are split over tasks. Ten more integer digits remain for the total. An
amount that does not fit (1e26 or more, infinite, not a number) is an error and
never leaves a total without a word.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(28,2)"
# No amount of this size or more fits.
LIMIT = 1e26


def exact(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.cast(EXACT)


def fits(value: Column) -> Column:
    """Whether an amount can be added up; a missing one can."""
    return F.coalesce((F.abs(value) < LIMIT) & ~F.isnan(value), F.lit(True))


def total(value: str | Column) -> Column:
    return F.sum(exact(value)).cast("double")


def total_or_zero(value: str | Column) -> Column:
    return F.coalesce(total(value), F.lit(0.0))


def mean(value: str | Column) -> Column:
    """Exact total over the number of non-null values; NULL when there are none."""
    return F.try_divide(total(value), F.count(exact(value)))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100; NULL when there is nothing to divide by."""
    return F.try_divide(part, whole) * 100.0


def contract_count() -> Column:
    return F.count(F.lit(1)).alias("total_contratos")


def value_total() -> Column:
    return total("valor_contrato").alias("valor_total")


def value_mean() -> Column:
    return mean("valor_contrato").alias("valor_promedio")
