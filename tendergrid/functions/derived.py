"""Per-contract and per-supplier indicators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and labels of the indicators.
HIGH_VALUE = 5_000_000_000
MANY_CONTRACTS = 100
SEVERAL_CONTRACTS = 50


def execution_pct(paid: Column, contracted: Column) -> Column:
    """Paid share in whole percent, halves up; NULL when either amount is 0 or missing."""
    return F.when(
        (paid != 0) & (contracted != 0), F.floor(paid / contracted * 100 + 0.5).cast("bigint")
    )


def execution_bar(paid: Column, contracted: Column) -> Column:
    """The same share as a bar length: 0 when unknown, at most 100."""
    return F.least(F.coalesce(execution_pct(paid, contracted), F.lit(0)), F.lit(100)).cast("bigint")


def is_high_value(value: Column) -> Column:
    return F.coalesce(value > HIGH_VALUE, F.lit(False))


def status_class(status: Column) -> Column:
    lowered = F.lower(status)
    return (
        F.when(lowered.contains("ejecución") | lowered.contains("activo"), "success")
        .when(lowered.contains("suspendido"), "warning")
        .otherwise("default")
    )


def concentration_level(contracts: Column) -> Column:
    return (
        F.when(contracts > MANY_CONTRACTS, "Alto")
        .when(contracts > SEVERAL_CONTRACTS, "Medio")
        .otherwise("Bajo")
    )
