"""Filters of contract rows."""

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import names_or_equals
from ..schemas import UPDATED_AT, YEAR

# Fixed value: how far an incremental read goes back behind the watermark.
LOOKBACK_DAYS = 7


def year_is(year: int) -> Column:
    """On the partition column, so other years are not even listed."""
    return F.col(YEAR) == year


def years_in(years: list[int]) -> Column:
    return F.col(YEAR).isin([int(year) for year in years])


def entity_matches(text: str) -> Column:
    return names_or_equals(F.col("nombre_entidad"), F.col("nit_entidad"), text)


def supplier_matches(text: str) -> Column:
    return names_or_equals(F.col("proveedor_adjudicado"), F.col("documento_proveedor"), text)


def modality_is(name: str) -> Column:
    return F.col("modalidad_contratacion") == name


def signed_from(day: dt.date) -> Column:
    return F.col("fecha_firma") >= F.lit(day)


def signed_until(day: dt.date) -> Column:
    return F.col("fecha_firma") <= F.lit(day)


def worth_from(amount: float) -> Column:
    return F.col("valor_contrato") >= amount


def worth_until(amount: float) -> Column:
    return F.col("valor_contrato") <= amount


def present(*names: str) -> Column:
    return reduce(and_, [F.col(name).isNotNull() for name in names])


@dataclass(frozen=True)
class ContractFilter:
    """Search parameters; None or empty text leaves a condition out, 0 is a limit like any other."""

    anio: int | None = None
    entidad: str | None = None
    proveedor: str | None = None
    modalidad: str | None = None
    fecha_desde: dt.date | None = None
    fecha_hasta: dt.date | None = None
    valor_min: float | None = None
    valor_max: float | None = None

    def conditions(self) -> list[Column]:
        rules = [
            (self.anio, year_is),
            (self.entidad, entity_matches),
            (self.proveedor, supplier_matches),
            (self.modalidad, modality_is),
            (self.fecha_desde, signed_from),
            (self.fecha_hasta, signed_until),
            (self.valor_min, worth_from),
            (self.valor_max, worth_until),
        ]
        conditions = [rule(value) for value, rule in rules if value is not None and value != ""]
        if self.fecha_desde or self.fecha_hasta:
            conditions.append(F.col(YEAR).between(*self._dated()))
        return conditions

    def _dated(self) -> tuple[int, int]:
        low = self.fecha_desde.year if self.fecha_desde else 1
        return low, self.fecha_hasta.year if self.fecha_hasta else 9999

    def years(self, known: list[int]) -> list[int]:
        """Those of the known years that can hold a contract of this filter."""
        low, high = self._dated()
        dated = self.fecha_desde or self.fecha_hasta
        return [y for y in known if (self.anio is None or y == self.anio) and (not dated or low <= y <= high)]

    def needs_rows(self) -> bool:
        """Whether a condition looks at more than the year."""
        return len(self.conditions()) > (self.anio is not None)

    def apply(self, contracts: DataFrame) -> DataFrame:
        return reduce(lambda rows, rule: rows.where(rule), self.conditions(), contracts)


def lookback(watermark: str | None, days: int = LOOKBACK_DAYS) -> str | None:
    """Midnight `days` before the watermark; text that is no date is used as it is."""
    if not watermark:
        return None
    try:
        day = dt.datetime.strptime(watermark[:10], "%Y-%m-%d").date()
    except ValueError:
        return watermark
    return (day - dt.timedelta(days=days)).isoformat() + "T00:00:00.000"


def updated_since(rows: DataFrame, watermark: str | None, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Rows an incremental run has to look at; everything when there is no watermark."""
    start = lookback(watermark, days)
    return rows if start is None else rows.where(F.col(UPDATED_AT) >= start)


def due_since(rows: DataFrame, watermark: str | None, days: int = LOOKBACK_DAYS) -> DataFrame:
    """updated_since, and the rows that do not say when they were updated: a load must not lose them."""
    start = lookback(watermark, days)
    return rows if start is None else rows.where(F.col(UPDATED_AT).isNull() | (F.col(UPDATED_AT) >= start))
