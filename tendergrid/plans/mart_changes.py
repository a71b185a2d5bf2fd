"""Marts kept by difference: a batch costs what it changes, not the years it touches.

Beside a mart lies its state: per group the number of contracts, of amounts and
their exact sum, and a count for every name, amount and counted id of the group.
All of it is additive, so rows that leave a group are subtracted like rows that
enter it, and the figures that are not additive (greatest name, extremes,
distinct ids) follow from the counts that are not zero. A contract that moves to
another year leaves one group and enters another.

Changes are rows of contracts with a weight: -1 for a version that goes, 1 for one
that comes (any other whole number stands for so many equal rows). Their state
is appended as a new part; parts add up when read, and once there are
MOST_PARTS of them they are added up for good. Then only the groups in the new
part are made anew from the state; the other groups of their years are copied
from the mart. No contract that did not change is read.

State follows the contracts of the lake: whatever replaces those or the mart in
another way drops it (lake.put_gold, marts.put_mart).
"""

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import money
from ..operators.predicates import present, years_in
from ..schemas import YEAR
from ..sources import versions
from ..sources.lake import STATE

WEIGHT, PART = "peso", "parte"
MOST_PARTS = 8
# So many touched groups at most are sent to every task.
FEW_GROUPS = 100_000
# Contract columns that any mart reads.
COLUMNS = [
    "nit_entidad", "nombre_entidad", "documento_proveedor", "proveedor_adjudicado",
    "modalidad_contratacion", "fecha_firma", "valor_contrato", YEAR,
]
_PLACE = [YEAR, "grupo", "campo", "dato", "cifra"]


@dataclass(frozen=True)
class Rules:
    """How the rows of a mart follow from contracts: whom to count, by what, and what else to keep per group."""

    needed: list[str]
    column: str
    group: str
    # Contract column and mart column of the greatest text, and of the number of distinct values.
    greatest: tuple[str, str] | None = None
    distinct: tuple[str, str] | None = None
    extremes: bool = False


RULES = {
    "mart_entidades": Rules(
        ["nit_entidad", "nombre_entidad", "fecha_firma"], "nit_entidad", "nit_entidad",
        ("nombre_entidad", "nombre_entidad"), ("documento_proveedor", "proveedores_unicos"), extremes=True,
    ),
    "mart_proveedores": Rules(
        ["documento_proveedor", "proveedor_adjudicado", "fecha_firma"], "documento_proveedor", "documento_proveedor",
        ("proveedor_adjudicado", "proveedor"), ("nit_entidad", "entidades_unicas"),
    ),
    "mart_temporal": Rules(["fecha_firma"], "mes", "month(fecha_firma)"),
    "mart_modalidades": Rules(["modalidad_contratacion", "fecha_firma"], "modalidad", "modalidad_contratacion"),
}


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """What leads from one set of contracts to another, as weighted rows; rows in both cancel out."""
    columns = [name for name in COLUMNS if name in before.columns]
    return weighted(before, after).groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def weighted(gone: DataFrame, come: DataFrame) -> DataFrame:
    """Contracts that go and contracts that come as one set of changes."""
    columns = [name for name in COLUMNS if name in gone.columns]
    sides = [rows.select(*columns, F.lit(weight).cast("bigint").alias(WEIGHT)) for rows, weight in ((gone, -1), (come, 1))]
    return sides[0].unionByName(sides[1])


def counted(name: str, contracts: DataFrame) -> DataFrame:
    """State of contracts, or of weighted changes: added up in the map tasks first, by hash."""
    rules = RULES[name]
    weight = F.col(WEIGHT) if WEIGHT in contracts.columns else F.lit(1).cast("bigint")

    def item(field, text=None, number=None, amount=None):
        return F.struct(
            F.lit(field).alias("campo"),
            (F.col(text) if text else F.lit(None)).cast("string").alias("dato"),
            (F.col(number) if number else F.lit(None)).cast("double").alias("cifra"),
            (money.exact(amount) if amount else F.lit(None).cast(money.EXACT)).alias("_importe"),
        )

    items = [item("total", amount="valor_contrato")]
    if rules.greatest:
        items.append(item("nombre", text=rules.greatest[0]))
    if rules.distinct:
        items.append(item("contado", text=rules.distinct[0]))
    if rules.extremes:
        items.append(item("valor", number="valor_contrato"))
    rows = contracts.where(present(*rules.needed)).select(
        YEAR, F.expr(rules.group).cast("string").alias("grupo"), weight.alias(WEIGHT), F.inline(F.array(*items))
    )
    rows = rows.where((F.col("campo") == "total") | F.col("dato").isNotNull() | F.col("cifra").isNotNull())
    zero = F.lit(0).cast("decimal(38,2)")
    return rows.groupBy(*_PLACE).agg(
        F.sum(WEIGHT).alias("n"),
        F.sum(F.when(F.col("_importe").isNull(), 0).otherwise(F.col(WEIGHT))).alias("con_importe"),
        F.coalesce(F.sum(F.col("_importe") * F.col(WEIGHT)), zero).cast("decimal(38,2)").alias("suma"),
    ).where("n != 0 OR con_importe != 0 OR suma != 0")


def added_up(state: DataFrame) -> DataFrame:
    """One row per counted thing from the parts of the state; what came to nothing goes."""
    sums = [F.sum(name).alias(name) for name in ("n", "con_importe")]
    total = F.sum("suma").cast("decimal(38,2)").alias("suma")
    return state.groupBy(*_PLACE).agg(*sums, total).where("n != 0 OR con_importe != 0 OR suma != 0")


def mart_rows(name: str, state: DataFrame) -> DataFrame:
    """Rows of the mart, without shares of the year, from state that is added up.

    Names are looked for apart from the figures, so only names are sorted. A
    group with a count below zero shows, and the range check of the mart stops it.
    """
    rules = RULES[name]

    def of(field, column):
        return F.when(F.col("campo") == field, F.col(column))

    figures = state.groupBy(YEAR, "grupo").agg(
        F.coalesce(F.sum(of("total", "n")), F.lit(0)).alias("total_contratos"),
        F.sum("con_importe").alias("_importes"),
        F.sum("suma").cast("double").alias("_suma"),
        F.count(of("contado", "n")).alias("_distintos"),
        F.max(of("valor", "cifra")).alias("valor_maximo"),
        F.min(of("valor", "cifra")).alias("valor_minimo"),
    ).where("total_contratos != 0")
    figures = figures.withColumn("valor_total", F.when(F.col("_importes") != 0, F.col("_suma")))
    figures = figures.withColumn("valor_promedio", F.try_divide("valor_total", "_importes"))
    if rules.greatest:
        names = state.where(F.col("campo") == "nombre").groupBy(YEAR, "grupo").agg(F.max("dato").alias(rules.greatest[1]))
        figures = figures.join(names, [YEAR, "grupo"])
    if rules.distinct:
        figures = figures.withColumn(rules.distinct[1], F.col("_distintos"))
    return figures.withColumn(rules.column, F.col("grupo"))


def _ordered(state: DataFrame, part: int) -> DataFrame:
    """Ready to be written as one part; sorted, so that row groups of other years and groups are skipped.

    State comes from an aggregate by all of _PLACE, so it is spread evenly and needs no further shuffle.
    """
    return state.withColumn(PART, F.lit(part)).sortWithinPartitions(*_PLACE[:3])


def put_state(made: versions.Publication, name: str, contracts: DataFrame) -> None:
    """Stage the state of all contracts as the only part."""
    made.put(name + STATE, _ordered(counted(name, contracts), made.base.number + 1), PART)


def put_changes(made: versions.Publication, name: str, changes: DataFrame, put, finish, years: list[int] | None = None) -> versions.Table:
    """Stage the changes as a part of the state, and the mart with the touched groups made anew.

    put(rows, years) stages mart rows, finish(rows) adds what depends on a whole
    year. years may name more years than the changes touch.
    """
    kept, before, part = name + STATE, made.base.tables[name], made.base.number + 1
    known = made.base.tables[kept]
    made.tables[kept] = known
    after = made.put(kept, _ordered(counted(name, changes), part), PART, [part])
    if str(part) not in after.parts:
        return before
    touched = made.staged(kept).select(YEAR, "grupo").distinct()
    if touched.count() <= FEW_GROUPS:
        # A join by few groups would bring all their rows into few tasks.
        touched = F.broadcast(touched)
    if years is None:
        # At most ten thousand years exist.
        years = [row[YEAR] for row in touched.select(YEAR).distinct().collect()]
    state = made.scan(kept).where(years_in(years)).join(touched, [YEAR, "grupo"], "left_semi")
    schema = StructType.fromJson(json.loads(before.schema))
    rows = made.scan(name).where(years_in(years))
    column = schema[RULES[name].column]
    rest = rows.join(touched.select(YEAR, F.col("grupo").cast(column.dataType).alias(column.name)), [YEAR, column.name], "left_anti")
    fresh = mart_rows(name, added_up(state))
    plain = [column for column in schema if column.name in fresh.columns]
    fresh = fresh.select(*[F.col(column.name).cast(column.dataType) for column in plain])
    table = put(finish(rest.select(*fresh.columns).unionByName(fresh)).select(*schema.names), sorted(years))
    # Staging the mart dropped its state.
    made.tables[kept] = after
    if len(after.parts) > MOST_PARTS:
        made.put(kept, _ordered(added_up(made.scan(kept)), part), PART, sorted(map(int, after.parts)))
    return table
