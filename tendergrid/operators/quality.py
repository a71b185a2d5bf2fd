"""Checks: guards that raise, reports that count."""

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, money
from ..schemas import DATE_COLUMNS, KEY, MONEY_COLUMNS, SILVER_COLUMNS, YEAR

log = logging.getLogger(__name__)

# Fixed value: a merge may not leave less than this part of the former rows.
KEEP_AT_LEAST = 0.90


class DataQualityError(ValueError):
    """A table failed one of its checks."""


def check_row_count(old: int, new: int) -> None:
    """Stop a merge that would lose more than a tenth of the table."""
    if old and new < int(old * KEEP_AT_LEAST):
        raise DataQualityError(f"{new} rows left of {old}, at least {int(old * KEEP_AT_LEAST)} expected")


def row_count_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same guard as one row of counts, for a report instead of an exception."""
    counts = old.agg(F.count(F.lit(1)).alias("anteriores")).select(
        "anteriores", new.agg(F.count(F.lit(1))).scalar().alias("nuevos")
    )
    minimum = F.floor(F.col("anteriores").cast("double") * KEEP_AT_LEAST).cast("bigint")
    return counts.withColumn("minimo", minimum).withColumn(
        "aceptado", (F.col("anteriores") == 0) | (F.col("nuevos") >= F.col("minimo"))
    )


def silver_validate(rows: DataFrame) -> DataFrame:
    """Rows per year of a typed table that is not empty and has its year column."""
    if YEAR not in rows.columns:
        raise DataQualityError(f"the typed table has no column {YEAR}")
    if KEY not in rows.columns:
        log.warning("the typed table has no column %s: uniqueness cannot be checked", KEY)
    if rows.isEmpty():
        raise DataQualityError("the typed table is empty")
    return rows.groupBy(F.col(YEAR).cast("bigint").alias(YEAR)).agg(
        F.count(F.lit(1)).alias("registros")
    )


# The allowed range of each mart column.
MART_RANGES = {
    "mart_entidades": {"total_contratos": (0, None), "valor_total": (0, None)},
    "mart_proveedores": {"valor_total": (0, None)},
    "mart_temporal": {"mes": (1, 12), "total_contratos": (0, None)},
    "mart_modalidades": {"participacion_pct": (0, 100)},
}


def out_of_range(name: str) -> Column:
    """Whether a row of the mart leaves an allowed range."""
    outside = F.lit(False)
    for column, (low, high) in MART_RANGES[name].items():
        if low is not None:
            outside = outside | (F.col(column) < low)
        if high is not None:
            outside = outside | (F.col(column) > high)
    return F.coalesce(outside, F.lit(False))


def mart_violations(name: str, mart: DataFrame) -> DataFrame:
    """One row: rows of the mart and how many of them leave an allowed range."""
    return mart.agg(
        F.lit(name).alias("mart"),
        F.count(F.lit(1)).alias("filas"),
        F.count_if(out_of_range(name)).alias("fuera_de_rango"),
    )


def mart_validate(name: str, mart: DataFrame) -> int:
    """Rows of a mart; raises when one of them leaves an allowed range."""
    row = mart_violations(name, mart).first()
    if row["fuera_de_rango"]:
        raise DataQualityError(f"{name}: {row['fuera_de_rango']} of {row['filas']} rows out of range")
    return row["filas"]


def quality_report(rows: DataFrame) -> DataFrame:
    """Rows, columns and missing values of the three columns every query leans on."""
    def missing(name):
        absent = F.col(name).isNull() if name in rows.columns else F.lit(True)
        return F.count_if(absent).alias(f"{name}_nula")

    return rows.agg(
        F.count(F.lit(1)).alias("registros"),
        F.lit(len(rows.columns)).cast("bigint").alias("columnas"),
        missing("fecha_firma"),
        missing("valor_contrato"),
        missing(KEY),
    )


NO_FIT = "montos_fuera_de_rango"


def profile(rows: DataFrame) -> dict[str, Column]:
    """Figures of a row that add up: the missing values of quality_report and amounts no total can hold."""
    figures = {}
    for name in ("fecha_firma", "valor_contrato", KEY):
        figures[f"{name}_nula"] = F.col(name).isNull() if name in rows.columns else F.lit(True)
    misfit = F.lit(0)
    for name in MONEY_COLUMNS:
        if name in rows.columns:
            misfit = misfit + (~money.fits(F.col(name))).cast("int")
    return figures | {NO_FIT: misfit}


def check_amounts(figures: dict[str, int]) -> None:
    """Stop a load whose amounts cannot be added up, before anything is published."""
    if figures.get(NO_FIT):
        raise DataQualityError(f"{figures[NO_FIT]} amounts of {money.LIMIT:g} or more, infinite or not a number")


def cast_failure_counts(known: list[str]) -> list[Column]:
    """Aggregates over landing rows: texts present (n_) and texts that become NULL (x_), per date and amount column."""
    counts = []
    for column, source in _cast_sources(known):
        text = F.col(source)
        typed = cleaning.iso_date(text) if column in DATE_COLUMNS else cleaning.money(text)
        counts += [F.count(text).alias(f"n_{column}"), F.count_if(text.isNotNull() & typed.isNull()).alias(f"x_{column}")]
    return counts


def _cast_sources(known: list[str]) -> list[tuple[str, str]]:
    sources = {silver: page for silver, page, _ in SILVER_COLUMNS if page in known}
    return [(column, sources[column]) for column in DATE_COLUMNS + MONEY_COLUMNS if column in sources]


def cast_failure_report(pages: DataFrame) -> DataFrame:
    """Per date and amount column: texts present, and texts that became NULL."""
    totals = pages.agg(*cast_failure_counts(pages.columns))
    lines = [
        F.struct(F.lit(c).alias("columna"), F.col(f"n_{c}").alias("con_texto"), F.col(f"x_{c}").alias("sin_convertir"))
        for c, _ in _cast_sources(pages.columns)
    ]
    return totals.select(F.inline(F.array(*lines)))


def quality_rules(rows: DataFrame) -> DataFrame:
    """Violations of the data-dictionary rules, one row per rule; counted per key first, so one pass is enough."""
    per_key = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("nit_entidad").isNull()).alias("nit_entidad_nulo"),
        F.count_if(F.col("valor_contrato").isNull()).alias("valor_contrato_no_numerico"),
        F.count_if(F.col("valor_contrato") < 0).alias("valor_contrato_negativo"),
        F.count_if(F.col("fecha_firma").isNull()).alias("fecha_firma_invalida"),
    )
    added = [name for name in per_key.columns if name not in (KEY, "n")]
    no_key = F.col(KEY).isNull()
    totals = per_key.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in added],
        F.coalesce(F.sum(F.when(no_key, F.col("n"))), F.lit(0)).alias("id_contrato_nulo"),
        F.count_if(~no_key & (F.col("n") > 1)).alias("id_contrato_repetido"),
    )
    rules = F.array(
        *[F.struct(F.lit(c).alias("regla"), F.col(c).alias("violaciones")) for c in totals.columns]
    )
    return totals.select(F.inline(rules))
