"""Aggregates over contracts.

Every aggregate is partial before its shuffle, and a distinct count first
shuffles by the counted value too, so a large group never sits in one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derived, money
from ..schemas import UPDATED_AT, YEAR
from .predicates import entity_matches, present, supplier_matches


def _distinct(column: str, name: str):
    return F.count_distinct(F.col(column)).alias(name)


def _per_key(
    rows: DataFrame, keys: list[str], texts: list[str], amounts: dict[str, str], count: str
) -> DataFrame:
    """Per key: greatest of each text, number of rows, exact sum of each amount.

    The maximum of a text needs a sort of the rows, counts and sums only a hash
    table. So the rows are first added up per key and text, which leaves few
    rows per key, and only those are sorted.
    """
    added = [F.sum(money.exact(source)).alias(name) for name, source in amounts.items()]
    per_text = rows.groupBy(*keys, *texts).agg(F.count(F.lit(1)).alias(count), *added)
    return per_text.groupBy(*keys).agg(
        *[F.max(text).alias(text) for text in texts],
        F.sum(count).alias(count),
        *[F.sum(name).cast("double").alias(name) for name in amounts],
    )


# --- global figures ---------------------------------------------------------


def kpi(contracts: DataFrame) -> DataFrame:
    return contracts.agg(
        money.contract_count(),
        money.total_or_zero("valor_contrato").alias("valor_total"),
        F.coalesce(money.mean("valor_contrato"), F.lit(0.0)).alias("valor_promedio"),
        _distinct("proveedor_adjudicado", "contratistas_unicos"),
        _distinct("nombre_entidad", "entidades_unicas"),
        _distinct("localizacion", "localidades_cubiertas"),
    )


def count_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.agg(money.contract_count())


def count_entities(contracts: DataFrame) -> DataFrame:
    return contracts.agg(_distinct("nit_entidad", "total_entidades"))


def count_suppliers(contracts: DataFrame) -> DataFrame:
    return contracts.agg(_distinct("documento_proveedor", "total_proveedores"))


def total_values(contracts: DataFrame) -> DataFrame:
    return contracts.agg(
        money.total_or_zero("valor_contrato").alias("valor_total_contratado"),
        money.total_or_zero("valor_pagado").alias("valor_total_pagado"),
    )


def _year_bounds():
    signed = F.year("fecha_firma").cast("bigint")
    return (
        F.coalesce(F.min(signed), F.lit(0)).alias("anio_desde"),
        F.coalesce(F.max(signed), F.lit(0)).alias("anio_hasta"),
    )


def year_range(contracts: DataFrame) -> DataFrame:
    return contracts.agg(*_year_bounds())


def stats_overview(contracts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """All global counts and sums from one scan.

    The last update is the watermark of the latest run if given, else the
    greatest update time of the rows, if they carry one.
    """
    known = UPDATED_AT in contracts.columns
    latest = F.max(UPDATED_AT) if known else F.lit(None).cast("string")
    row = contracts.agg(
        money.contract_count(),
        _distinct("nit_entidad", "total_entidades"),
        _distinct("documento_proveedor", "total_proveedores"),
        money.total_or_zero("valor_contrato").alias("valor_total_contratado"),
        money.total_or_zero("valor_pagado").alias("valor_total_pagado"),
        *_year_bounds(),
        latest.alias("ultima_actualizacion"),
    )
    if state is None:
        return row
    return row.withColumn("ultima_actualizacion", state.select("watermark").scalar())


def count_unique_contractors(contracts: DataFrame) -> DataFrame:
    return contracts.agg(_distinct("proveedor_adjudicado", "total_contratistas"))


def available_years(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("fecha_firma"))
        .select(F.col(YEAR).cast("bigint").alias(YEAR))
        .distinct()
        .orderBy(YEAR)
    )


def yearly_totals(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy(F.year("fecha_firma").cast("bigint").alias("anio_firma")).agg(
        F.count(F.lit(1)).alias("cantidad"),
        money.total("valor_contrato").alias("total_contratado"),
    )


def yearly_contracted_vs_paid(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("fecha_firma"))
        .groupBy(F.col(YEAR).cast("bigint").alias(YEAR))
        .agg(
            money.total_or_zero("valor_contrato").alias("contratado"),
            money.total_or_zero("valor_pagado").alias("pagado"),
        )
    )


# --- groups -----------------------------------------------------------------


def contractors(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("proveedor_adjudicado"))
        .groupBy(F.col("proveedor_adjudicado").alias("contratista"))
        .agg(
            money.contract_count(),
            money.total_or_zero("valor_contrato").alias("valor_total"),
            F.coalesce(money.mean("valor_contrato"), F.lit(0.0)).alias("valor_promedio"),
        )
    )


def top_contractors(contracts: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return contractors(contracts).orderBy(F.desc("valor_total"), "contratista").limit(limit)


def by_locality(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("localizacion"))
        .groupBy(F.col("localizacion").alias("localidad"))
        .agg(
            money.contract_count(),
            money.total_or_zero("valor_contrato").alias("valor_total"),
            _distinct("proveedor_adjudicado", "contratistas_unicos"),
            _distinct("nombre_entidad", "entidades_unicas"),
        )
        .orderBy(F.desc("valor_total"), "localidad")
    )


def count_localities(contracts: DataFrame) -> DataFrame:
    return contracts.agg(_distinct("localizacion", "total_localidades"))


def modalities(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("modalidad_contratacion"))
        .groupBy(F.col("modalidad_contratacion").alias("modalidad"))
        .agg(money.contract_count(), money.value_total())
        .orderBy(F.desc("total_contratos"), "modalidad")
    )


TOTAL = {"valor_total": "valor_contrato"}


def _entity_figures(rows: DataFrame, *texts: str) -> DataFrame:
    names = ["nombre_entidad", *texts]
    figures = _per_key(rows, ["nit_entidad"], names, TOTAL, "total_contratos")
    return figures.select("nit_entidad", "nombre_entidad", "total_contratos", "valor_total", *texts)


def entity_list(contracts: DataFrame, search: str | None = None) -> DataFrame:
    rows = contracts.where(present("nit_entidad", "nombre_entidad"))
    rows = rows.where(entity_matches(search)) if search else rows
    return _entity_figures(rows, "sector")


def entity_count(contracts: DataFrame, search: str | None = None) -> DataFrame:
    rows = contracts.where(present("nit_entidad", "nombre_entidad"))
    rows = rows.where(entity_matches(search)) if search else rows
    return rows.agg(_distinct("nit_entidad", "total"))


def entity_detail(contracts: DataFrame, nit: str) -> DataFrame:
    rows = contracts.where(F.col("nit_entidad") == nit)
    return _entity_figures(rows, "sector", "departamento", "ciudad")


def _supplier_figures(rows: DataFrame) -> DataFrame:
    texts = ["proveedor_adjudicado", "es_pyme"]
    figures = _per_key(rows, ["documento_proveedor"], texts, TOTAL, "total_contratos")
    return figures.select(
        "documento_proveedor", "proveedor_adjudicado", "total_contratos", "valor_total", "es_pyme"
    )


def _named_suppliers(contracts: DataFrame, search: str | None) -> DataFrame:
    rows = contracts.where(present("documento_proveedor", "proveedor_adjudicado"))
    return rows.where(supplier_matches(search)) if search else rows


def supplier_list(contracts: DataFrame, search: str | None = None) -> DataFrame:
    return _supplier_figures(_named_suppliers(contracts, search))


def supplier_count(contracts: DataFrame, search: str | None = None) -> DataFrame:
    """Counts what supplier_list lists: the same rows, named suppliers only."""
    return _named_suppliers(contracts, search).agg(_distinct("documento_proveedor", "total"))


def supplier_detail(contracts: DataFrame, document: str) -> DataFrame:
    return _supplier_figures(contracts.where(F.col("documento_proveedor") == document))


def supplier_concentration(contracts: DataFrame) -> DataFrame:
    return supplier_list(contracts).withColumn(
        "riesgo", derived.concentration_level(F.col("total_contratos"))
    )


# --- dashboards -------------------------------------------------------------


def _entity_payments(contracts: DataFrame) -> DataFrame:
    amounts = {"contratado": "valor_contrato", "pagado": "valor_pagado"}
    rows = contracts.where(present("nit_entidad"))
    totals = _per_key(rows, ["nit_entidad"], ["nombre_entidad"], amounts, "n").na.fill(
        0.0, list(amounts)
    )
    return totals.withColumn("ejecucion_pct", money.percent(F.col("pagado"), F.col("contratado")))


def entity_execution(contracts: DataFrame) -> DataFrame:
    """Paid share per entity; both sums count a missing amount as nothing."""
    return _entity_payments(contracts).drop("n")


def entity_modality_breakdown(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("nit_entidad", "modalidad_contratacion"))
        .groupBy("nit_entidad", F.col("modalidad_contratacion").alias("modalidad"))
        .agg(F.count(F.lit(1)).alias("contratos"), money.total_or_zero("valor_contrato").alias("valor"))
    )


def entity_top_suppliers(contracts: DataFrame, k: int = 5) -> DataFrame:
    """The k suppliers with the highest value per entity.

    The rank limit is applied in each map task before the shuffle, so an
    entity with very many suppliers sends at most k rows per task.
    """
    rows = contracts.where(present("nit_entidad", "documento_proveedor"))
    pairs = _per_key(
        rows,
        ["nit_entidad", "documento_proveedor"],
        ["proveedor_adjudicado"],
        {"valor": "valor_contrato"},
        "contratos",
    ).withColumnRenamed("proveedor_adjudicado", "proveedor").na.fill(0.0, ["valor"])
    order = Window.partitionBy("nit_entidad").orderBy(F.desc("valor"), "documento_proveedor")
    return pairs.withColumn("puesto", F.row_number().over(order).cast("bigint")).where(
        F.col("puesto") <= k
    )


def supplier_kpis(contracts: DataFrame) -> DataFrame:
    rows = contracts.where(present("documento_proveedor"))
    per_supplier = _per_key(rows, ["documento_proveedor"], ["es_pyme"], {}, "n")
    suppliers = F.count(F.lit(1))
    return per_supplier.agg(
        suppliers.alias("total_proveedores"),
        F.try_divide(F.sum("n"), suppliers).alias("contratos_promedio"),
        money.percent(F.count_if(F.col("es_pyme") == "Si"), suppliers).alias("pyme_pct"),
        money.percent(
            F.count_if(F.col("n") > derived.SEVERAL_CONTRACTS), suppliers
        ).alias("concentracion_alta_pct"),
    )


def entity_kpis(contracts: DataFrame) -> DataFrame:
    """Means per entity. Shares are added as whole millionths, so their mean is exact."""
    entities = F.count(F.lit(1))
    millionths = F.floor(F.col("ejecucion_pct") * 1_000_000 + 0.5)
    return _entity_payments(contracts).agg(
        entities.alias("total_entidades"),
        F.try_divide(F.sum("n"), entities).alias("contratos_promedio"),
        F.try_divide(money.total("contratado"), entities).alias("valor_promedio"),
        (F.try_divide(F.sum(millionths), F.count(millionths)) / 1_000_000.0).alias(
            "ejecucion_promedio_pct"
        ),
    )


def unpaid_over_12_months(contracts: DataFrame, as_of) -> DataFrame:
    """Contracts signed more than a year before `as_of` without any payment."""
    return contracts.where(
        (F.coalesce(F.col("valor_pagado"), F.lit(0.0)) == 0)
        & (F.col("fecha_firma") < F.add_months(F.lit(as_of), -12))
    )
