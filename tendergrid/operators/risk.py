"""Contracts that stand out: suppliers with many contracts, values far above the supplier's mean."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..schemas import KEY
from .skew import HOT_ROWS, HOT_SHARE, attach_key_figures

# Default limits and the wording of the indicators.
MANY_CONTRACTS = 10
OUTLIER_TIMES = 5
CONCENTRATION = "concentracion"
OUTLIER = "valor_atipico"
OUTLIER_TEXT = "Valor atípico frente al promedio del contratista"

SUPPLIER = "proveedor_adjudicado"
COUNT = "total_contratos_contratista"
MEAN = "valor_promedio_contratista"


def contractor_stats(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(F.col(SUPPLIER).isNotNull())
        .groupBy(SUPPLIER)
        .agg(F.count(F.lit(1)).alias(COUNT), money.mean("valor_contrato").alias(MEAN))
    )


def contractor_stats_join(
    contracts: DataFrame, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Contracts of named suppliers with the supplier's contract count and mean value."""
    return attach_key_figures(
        contracts, contractor_stats(contracts), SUPPLIER, COUNT, KEY, hot_share, hot_rows
    )


def _concentrated(threshold: int):
    return F.col(COUNT) > threshold


def _outlier(times: int):
    return F.col("valor_contrato") > F.col(MEAN) * times


def flagged(
    contracts: DataFrame, threshold: int = MANY_CONTRACTS, times: int = OUTLIER_TIMES, **hot
) -> DataFrame:
    """Contracts over either limit with count and mean of their supplier."""
    if not 1 <= threshold <= 100 or not 2 <= times <= 20:
        raise ValueError("threshold is 1 to 100, times is 2 to 20")
    rows = contracts.select(KEY, "proceso_de_compra", SUPPLIER, "nombre_entidad", "valor_contrato")
    return contractor_stats_join(rows, **hot).where(_concentrated(threshold) | _outlier(times))


def risk_indicators(rows: DataFrame, threshold: int, times: int) -> DataFrame:
    """Add the list of indicator texts. A zero mean or value does not count as an outlier."""
    many = F.concat(F.lit("Alta concentración: "), F.col(COUNT).cast("string"), F.lit(" contratos"))
    unusual = _outlier(times) & (F.col(MEAN) != 0) & (F.col("valor_contrato") != 0)
    listed = F.array(F.when(_concentrated(threshold), many), F.when(unusual, OUTLIER_TEXT))
    return rows.withColumn("indicadores", F.array_compact(listed))


def risk_level(rows: DataFrame) -> DataFrame:
    found = F.size("indicadores")
    level = F.when(found >= 2, "alto").when(found == 1, "medio").otherwise("bajo")
    return rows.withColumn("nivel_riesgo", level)


def risk_contracts(
    contracts: DataFrame, threshold: int = MANY_CONTRACTS, times: int = OUTLIER_TIMES, **hot
) -> DataFrame:
    """Flagged contracts with indicators and level, highest value first."""
    rows = flagged(contracts, threshold, times, **hot)
    return (
        risk_level(risk_indicators(rows, threshold, times))
        .select(
            KEY,
            F.col("proceso_de_compra").alias("proceso_id"),
            F.col(SUPPLIER).alias("contratista"),
            F.col("nombre_entidad").alias("entidad"),
            F.coalesce("valor_contrato", F.lit(0.0)).alias("valor_contrato"),
            "nivel_riesgo",
            "indicadores",
        )
        .orderBy(F.desc("valor_contrato"), KEY)
    )


def risk_summary(
    contracts: DataFrame, threshold: int = MANY_CONTRACTS, times: int = OUTLIER_TIMES, **hot
) -> DataFrame:
    return flagged(contracts, threshold, times, **hot).agg(
        F.count(F.lit(1)).alias("total_analizados")
    )


def risk_types(
    contracts: DataFrame, threshold: int = MANY_CONTRACTS, times: int = OUTLIER_TIMES, **hot
) -> DataFrame:
    """One row per contract and reason, with the reason's short name and its text."""
    many = F.concat(F.lit("Alta concentración: "), F.col(COUNT).cast("string"), F.lit(" contratos"))
    reason = lambda when, kind, text: F.when(
        when, F.struct(F.lit(kind).alias("tipo_riesgo"), text.alias("descripcion"))
    )
    reasons = F.array_compact(
        F.array(
            reason(_concentrated(threshold), CONCENTRATION, many),
            reason(_outlier(times), OUTLIER, F.lit(OUTLIER_TEXT)),
        )
    )
    return flagged(contracts, threshold, times, **hot).select(
        KEY,
        F.col(SUPPLIER).alias("proveedor"),
        "valor_contrato",
        F.col(COUNT).alias("contratos_proveedor"),
        F.inline(reasons),
    )
