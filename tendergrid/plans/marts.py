"""Pre-aggregated tables by entity, supplier, month and modality, one partition per year."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import quality
from ..operators.predicates import present, years_in
from ..schemas import YEAR
from ..session import REWRITE, settings, table_file_size
from ..sources import lake, versions
from . import mart_changes

OUT_OF_RANGE = "fuera_de_rango"


def mart_entidades(contracts: DataFrame) -> DataFrame:
    """Figures from hash aggregates; the greatest name from the distinct names of each group.

    Spark keeps no text in a hash aggregate's buffer: with the name among the
    figures, every phase would sort all contracts. As grouping keys names are
    hashed, and only one row per distinct name is left to sort. Both sides end
    up partitioned by the group, so the join moves nothing more.
    """
    rows = contracts.where(present("nit_entidad", "nombre_entidad", "fecha_firma"))
    group = ["nit_entidad", YEAR]
    figures = rows.groupBy(*group).agg(
        money.value_total(),
        money.value_mean(),
        F.max("valor_contrato").alias("valor_maximo"),
        F.min("valor_contrato").alias("valor_minimo"),
        F.count_distinct("documento_proveedor").alias("proveedores_unicos"),
    )
    # The counts keep the optimizer from dropping the first of the two levels.
    named = rows.groupBy(*group, "nombre_entidad").agg(money.contract_count())
    names = named.groupBy(*group).agg(
        F.max("nombre_entidad").alias("nombre_entidad"), F.sum("total_contratos").alias("total_contratos")
    )
    return names.join(figures, group)


def mart_proveedores(contracts: DataFrame) -> DataFrame:
    """Nearly as many rows as contracts: few contracts share a supplier and a year.

    So there are nearly as many distinct names as contracts too, and taking them
    apart as for entities saves no sorting (measured over 5.4 million contracts:
    9.3 s, with the name among the figures 8.7 s).
    """
    return (
        contracts.where(present("documento_proveedor", "proveedor_adjudicado", "fecha_firma"))
        .groupBy("documento_proveedor", YEAR)
        .agg(
            F.max("proveedor_adjudicado").alias("proveedor"),
            money.contract_count(),
            money.value_total(),
            money.value_mean(),
            F.count_distinct("nit_entidad").alias("entidades_unicas"),
        )
    )


def mart_temporal(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("fecha_firma"))
        .groupBy(YEAR, F.month("fecha_firma").alias("mes"))
        .agg(money.contract_count(), money.value_total(), money.value_mean())
    )


def modality_totals(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(present("modalidad_contratacion", "fecha_firma"))
        .groupBy(F.col("modalidad_contratacion").alias("modalidad"), YEAR)
        .agg(money.contract_count(), money.value_total())
    )


def year_total_join(rows: DataFrame) -> DataFrame:
    """Add the total value of the row's year.

    There are at most ten thousand years in a date column, so their totals
    are broadcast: rows of one year are never brought together for this.
    """
    per_year = rows.groupBy(YEAR).agg(money.total("valor_total").alias("total_anio"))
    return rows.join(F.broadcast(per_year), YEAR)


def participation_pct(rows: DataFrame) -> DataFrame:
    share = money.percent(F.col("valor_total"), F.col("total_anio"))
    return year_total_join(rows).withColumn("participacion_pct", share).drop("total_anio")


def mart_modalidades(contracts: DataFrame) -> DataFrame:
    return participation_pct(modality_totals(contracts))


@dataclass(frozen=True)
class Mart:
    name: str
    build: Callable[[DataFrame], DataFrame]
    order: list[str] = field(default_factory=list)


MARTS = [
    Mart("mart_entidades", mart_entidades, ["nit_entidad"]),
    Mart("mart_proveedores", mart_proveedores, ["documento_proveedor"]),
    Mart("mart_temporal", mart_temporal, ["mes"]),
    Mart("mart_modalidades", mart_modalidades, ["modalidad"]),
]
MART = {mart.name: mart for mart in MARTS}


def mart_sort(mart: Mart, rows: DataFrame) -> DataFrame:
    """Year by year and sorted by key inside each task, ready for a partitioned write."""
    return lake.spread_by_year(rows).sortWithinPartitions(YEAR, *mart.order)


def mart_read(spark: SparkSession, mart: Mart, root: str) -> DataFrame | None:
    """The published mart, registered as a view; None when it was never written."""
    rows = versions.scan(spark, root, mart.name)
    if rows is not None:
        rows.createOrReplaceTempView(mart.name)
    return rows


def put_mart(made: versions.Publication, mart: Mart, rows: DataFrame, years: list[int] | None = None) -> versions.Table:
    """Stage a mart, or some years of it; raises if a row leaves an allowed range.

    The ranges are checked on the files just written, in the pass that counts
    them, so the aggregation runs once and nothing is written twice. Counts kept
    for the mart go, since nobody says here what changed.
    """
    broken = {OUT_OF_RANGE: quality.out_of_range(mart.name)}
    made.tables.pop(mart.name + lake.STATE, None)
    table = made.put(mart.name, mart_sort(mart, rows), YEAR, years, broken)
    outside = table.profile().get(OUT_OF_RANGE)
    if outside:
        raise quality.DataQualityError(f"{mart.name}: {outside} of {table.total('rows')} rows out of range")
    return table


def mart_write(mart: Mart, rows: DataFrame, root: str) -> int:
    """Publish a mart, register its view and return the number of its rows."""
    spark = rows.sparkSession
    with versions.Publication(spark, root) as made:
        table = put_mart(made, mart, rows)
        made.commit()
    mart_read(spark, mart, root)
    return table.total("rows")


def _put_from(made: versions.Publication, mart: Mart, contracts: DataFrame, years: list[int] | None) -> versions.Table:
    """Every mart is grouped by year, so a year's rows depend on that year's contracts only; a modality's share too."""
    if years is None or mart.name not in made.tables:
        return put_mart(made, mart, mart.build(contracts))
    if not years:
        return made.tables[mart.name]
    return put_mart(made, mart, mart.build(contracts.where(years_in(years))), years)


def put_changed(made: versions.Publication, mart: Mart, changes: DataFrame, years: list[int] | None = None) -> versions.Table:
    """Stage a mart brought up to date by weighted changes of contracts; see mart_changes."""
    finish = participation_pct if mart.name == "mart_modalidades" else lambda rows: rows
    return mart_changes.put_changes(
        made, mart.name, changes, lambda rows, touched: put_mart(made, mart, rows, touched), finish, years
    )


def _put_batch(made: versions.Publication, mart: Mart, contracts: DataFrame, years: list[int], changes: DataFrame) -> versions.Table:
    """By difference if counts are kept for the mart; else from the years' contracts, and counts are kept from now on."""
    if mart.name in made.base.tables and mart.name + lake.STATE in made.base.tables:
        return put_changed(made, mart, changes, years)
    table = _put_from(made, mart, contracts, years)
    mart_changes.put_state(made, mart.name, contracts)
    return table


def put_marts(
    made: versions.Publication, contracts: DataFrame, years: list[int] | None = None, changes: DataFrame | None = None
) -> dict[str, int]:
    """Stage all four marts, complete, for some years only, or by the changes of a batch to those years. Returns rows per mart.

    They do not depend on each other, so their jobs are handed to Spark together.
    A task reads no more contracts than its aggregates can hold by group.
    """

    def one(mart: Mart) -> versions.Table:
        if changes is None or not years:
            return _put_from(made, mart, contracts, years)
        return _put_batch(made, mart, contracts, years, changes)

    few = settings(contracts.sparkSession, {"spark.sql.files.maxPartitionBytes": REWRITE["spark.sql.files.maxPartitionBytes"]})
    with few, table_file_size(contracts.sparkSession), ThreadPoolExecutor(len(MARTS)) as together:
        tables = list(together.map(one, MARTS))
    return {mart.name: table.total("rows") for mart, table in zip(MARTS, tables, strict=True)}


def mart_incremental(mart: Mart, contracts: DataFrame, root: str, years: list[int]) -> int:
    """Recompute the given years of a mart and leave the others alone."""
    spark = contracts.sparkSession
    with versions.Publication(spark, root) as made:
        table = _put_from(made, mart, contracts, years)
        if made.folders:
            made.commit()
    mart_read(spark, mart, root)
    return table.total("rows")


def mart_start(mart: Mart, contracts: DataFrame, root: str) -> int:
    """Publish a mart with the counts that later changes are added to."""
    spark = contracts.sparkSession
    with versions.Publication(spark, root) as made:
        table = put_mart(made, mart, mart.build(contracts))
        mart_changes.put_state(made, mart.name, contracts)
        made.commit()
    mart_read(spark, mart, root)
    return table.total("rows")


def mart_change(mart: Mart, changes: DataFrame, root: str) -> int:
    """Publish a started mart after weighted changes of contracts; only groups they touch are made anew."""
    spark = changes.sparkSession
    with versions.Publication(spark, root) as made:
        table = put_changed(made, mart, changes)
        made.commit()
    mart_read(spark, mart, root)
    return table.total("rows")


def build_marts(contracts: DataFrame, root: str, years: list[int] | None = None) -> dict[str, int]:
    """Publish all four marts together, complete or for some years only. Returns rows per mart.

    Each mart reads only its few columns of the contracts, which costs less
    than keeping all of them in memory for four passes.
    """
    spark = contracts.sparkSession
    with versions.Publication(spark, root) as made:
        counts = put_marts(made, contracts, years)
        if made.folders:
            made.commit()
    for mart in MARTS:
        mart_read(spark, mart, root)
    return counts
