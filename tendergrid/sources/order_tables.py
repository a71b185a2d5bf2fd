"""Contracts derived from a star schema of orders, customers and nations.

An order stands for a contract, its customer for the supplier, the nation for
the contracting entity and its line items for invoices and payments. Some
fields are missing or unreadable for whole classes of orders, the way they are
in real procurement data.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEY, SILVER_COLUMNS, UNTYPED_PAGE_COLUMNS, UPDATED_AT, YEAR
from ..session import COMPRESSION, settings
from . import lake

ISO_TEXT = "yyyy-MM-dd'T'00:00:00.000"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _by(column: str, day: dt.date) -> Column:
    return F.col(column) < F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz")


def _until(rows: DataFrame, column: str, day: dt.date | None) -> DataFrame:
    return rows if day is None else rows.where(_by(column, day))


def invoices(spark: SparkSession, folder: str, until: dt.date | None = None) -> DataFrame:
    """Per order: invoiced and paid amount, first and last shipment, number of lines."""
    lines = _until(_table(spark, folder, "lineitem"), "l_shipdate", until)
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    net = price * (1 - F.col("l_discount").cast("decimal(4,2)"))
    paid = F.sum(F.when(F.col("l_linestatus") == "F", net))
    return lines.groupBy("l_orderkey").agg(
        F.round(paid, 2).cast("double").alias("pagado"),
        F.sum(price).cast("double").alias("facturado"),
        F.min("l_shipdate").cast("date").alias("primera"),
        F.max("l_shipdate").cast("date").alias("ultima"),
        F.count(F.lit(1)).alias("lineas"),
    )


# What invoices() has of an order, and the mark of what was known on an earlier day.
FIGURES, EARLIER = ["pagado", "facturado", "primera", "ultima", "lineas"], "antes_"


def _invoices_twice(spark: SparkSession, folder: str, until: dt.date) -> DataFrame:
    """The figures of invoices() over all lines and, marked as earlier, over those until a day, in one pass."""
    lines, early = _table(spark, folder, "lineitem"), _by("l_shipdate", until)
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = lines.select(
        "l_orderkey", price.alias("price"), F.col("l_shipdate").cast("date").alias("shipped"), early.alias("early"),
        F.when(F.col("l_linestatus") == "F", price * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("paid"),
    )

    def figures(kept):
        return [
            F.round(F.sum(kept("paid")), 2).cast("double"),
            F.sum(kept("price")).cast("double"),
            F.min(kept("shipped")),
            F.max(kept("shipped")),
        ]

    of_all = [*figures(F.col), F.count(F.lit(1))]
    of_early = [*figures(lambda name: F.when(F.col("early"), F.col(name))), F.nullif(F.count_if("early"), F.lit(0))]
    return lines.groupBy("l_orderkey").agg(
        *[value.alias(name) for name, value in zip(FIGURES, of_all, strict=True)],
        *[value.alias(EARLIER + name) for name, value in zip(FIGURES, of_early, strict=True)],
    )


def _from_orders():
    key = F.col("o_orderkey").cast("string")
    halted = F.col("o_orderstatus") == "P"
    signed = F.when(
        ~(halted & (F.col("o_orderpriority") == "4-NOT SPECIFIED")), F.col("o_orderdate").cast("date")
    )
    status = F.when(F.col("o_orderstatus") == "O", "En ejecución").when(halted, "Suspendido")
    return {
        "id_contrato": key,
        "proceso_de_compra": F.concat(F.lit("PROC."), key),
        "estado_contrato": status.otherwise("Cerrado"),
        "documento_proveedor": F.when(
            ~(halted & (F.col("o_orderpriority") == "1-URGENT")), F.col("o_custkey").cast("string")
        ),
        "fecha_firma": signed,
        "valor_contrato": F.when(
            ~(halted & (F.col("o_orderpriority") == "5-LOW")), F.col("o_totalprice")
        ),
        "modalidad_contratacion": F.when(
            ~((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "3-MEDIUM")),
            F.col("o_orderpriority"),
        ),
        "rama": F.lit("Ejecutivo"),
        "origen_recursos": F.lit("Distribuido"),
        "destino_gasto": F.lit("Inversión"),
        "es_postconflicto": F.lit("No"),
        "objeto_contrato": F.concat(F.lit("Suministro | "), key),
        "url_proceso": F.concat(F.lit('{"url":"https://example.org/'), key, F.lit('"}')),
        YEAR: F.coalesce(F.year(signed), F.lit(0)),
    }


def _from_customers():
    return {
        "proveedor_adjudicado": F.when(F.col("c_acctbal") >= -800, F.col("c_name")),
        "sector": F.col("c_mktsegment"),
        "tipo_contrato": F.concat(F.lit("Suministro "), F.col("c_mktsegment")),
        "es_pyme": F.when(F.col("c_acctbal") < 2500, "Si").otherwise("No"),
        "nit_entidad": F.when(
            ~((F.col("c_nationkey") == 24) & (F.col("c_acctbal") < 0)),
            F.col("c_nationkey").cast("string"),
        ),
    }


def _from_places():
    unplaced = (F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("n_nationkey") == 0)
    return {
        "nombre_entidad": F.col("n_name"),
        "ciudad": F.col("n_name"),
        "departamento": F.col("r_name"),
        "localizacion": F.when(~unplaced, F.col("r_name")),
    }


def _from_invoices():
    last_seen = F.greatest(F.col("o_orderdate").cast("date"), F.col("ultima"))
    days = F.datediff("ultima", "primera").cast("string")
    return {
        "fecha_inicio": F.col("primera"),
        "fecha_fin": F.col("ultima"),
        "duracion_contrato": F.concat(days, F.lit(" Dia(s)")),
        "dias_adicionados": F.col("lineas").cast("string"),
        "valor_facturado": F.col("facturado"),
        "valor_pagado": F.col("pagado"),
        UPDATED_AT: F.date_format(last_seen, ISO_TEXT),
    }


def contracts(
    spark: SparkSession,
    folder: str,
    columns: list[str] | None = None,
    until: dt.date | None = None,
    by_year: bool = False,
) -> DataFrame:
    """One row per order signed by `until`, with the wanted columns (all of them by default).

    The planner cannot know that customers and nations have unique keys, so it
    would keep joins whose columns nobody reads; only the needed ones are made.
    A customer with very many orders is a skewed join key, which adaptive
    execution splits. Invoices are joined first, so that no text of a customer
    goes through the shuffle by order. by_year brings the rows of a year
    together, sorted by key, before the texts of the contract are made from them.
    """
    groups = [_from_orders(), _from_customers(), _from_places(), _from_invoices()]
    of_orders, of_customers, of_places, of_invoices = groups
    known = of_orders | of_customers | of_places | of_invoices
    names = columns or list(known)
    rows = _until(_table(spark, folder, "orders"), "o_orderdate", until)
    if set(names) & set(of_invoices):
        billed = invoices(spark, folder, until)
        rows = rows.join(billed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if set(names) & (set(of_customers) | set(of_places)):
        customers = _table(spark, folder, "customer")
        rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    if set(names) & set(of_places):
        nations, regions = _table(spark, folder, "nation"), _table(spark, folder, "region")
        places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        rows = rows.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if by_year:
        rows = rows.withColumns({"_anio": known[YEAR], "_clave": known[KEY]})
        known = known | {YEAR: F.col("_anio"), KEY: F.col("_clave")}
        rows = lake.spread_by_year(rows, "_anio").sortWithinPartitions("_anio", "_clave")
    return rows.select(*[known[name].alias(name) for name in names])


def as_pages(rows: DataFrame) -> DataFrame:
    """Contracts as landing text: padded names, signs in amounts, unreadable dates and values."""
    texts, known, nothing = [], set(rows.columns), F.lit(None).cast("string")
    for silver, page, kind in SILVER_COLUMNS:
        if silver not in known:
            value = nothing
        elif kind == "date":
            value = F.date_format(silver, ISO_TEXT)
        elif kind == "money":
            value = F.col(silver).cast("decimal(18,2)").cast("string")
        else:
            value = F.col(silver)
        if silver == "nombre_entidad":
            value = F.concat(F.lit("  "), value, F.lit(" \t"))
        elif silver == "fecha_firma":
            value = F.coalesce(value, F.lit("NO DEFINIDO"))
        elif silver == "valor_contrato":
            value = F.coalesce(F.concat(F.lit("$ "), value), F.lit("N/A"))
        texts.append(value.alias(page))
    texts.append((F.col(UPDATED_AT) if UPDATED_AT in known else nothing).alias(UPDATED_AT))
    texts += [nothing.alias(name) for name in UNTYPED_PAGE_COLUMNS]
    return rows.select(*texts)


def _deal_out(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Spread the rows over the cores when their source is too small to be split that far.

    Some eighty texts per row are much work, and a table of one file split
    would leave all of it to one core. A large table has more splits than
    cores and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if source.rdd.getNumPartitions() < cores else rows


def page_rows(spark: SparkSession, folder: str, until: dt.date | None = None) -> DataFrame:
    rows = contracts(spark, folder, until=until)
    return as_pages(_deal_out(rows, _table(spark, folder, "orders")))


def page_rows_twice(spark: SparkSession, folder: str, until: dt.date, path: str) -> tuple[DataFrame, DataFrame]:
    """page_rows until a day and page_rows of today; what both are made of is joined once and stored at path."""
    customers, billed = _table(spark, folder, "customer"), _invoices_twice(spark, folder, until)
    nations, regions = _table(spark, folder, "nation"), _table(spark, folder, "region")
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = _table(spark, folder, "orders")
    rows = rows.join(billed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice",
        "c_name", "c_acctbal", "c_mktsegment", "c_nationkey", "n_nationkey", "n_name", "r_name",
        *FIGURES, *[EARLIER + name for name in FIGURES],
    )
    # Few lines a task, or what it adds up by order before the shuffle would spill.
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "16m"}):
        rows.write.option("compression", COMPRESSION).parquet(path)
    today = spark.read.parquet(path)
    earlier = _until(today, "o_orderdate", until).drop(*FIGURES)
    earlier = earlier.withColumnsRenamed({EARLIER + name: name for name in FIGURES})
    known = _from_orders() | _from_customers() | _from_places() | _from_invoices()

    def made(state):
        return as_pages(_deal_out(state.select(*[value.alias(name) for name, value in known.items()]), today))

    return made(earlier), made(today)


def shipment_feed(spark: SparkSession, folder: str) -> DataFrame:
    """One landing row per shipment: the contract as of that day, so a key comes many times."""
    lines = _table(spark, folder, "lineitem")
    shipments = lines.select(
        F.col("l_orderkey").cast("string").alias("id_contrato"),
        F.col("l_extendedprice").alias("valor_facturado"),
        F.date_format(F.col("l_shipdate").cast("date"), ISO_TEXT).alias(UPDATED_AT),
    )
    columns = ["id_contrato", "nombre_entidad", "nit_entidad", "fecha_firma", "valor_contrato"]
    rows = contracts(spark, folder, columns).join(shipments, "id_contrato")
    return as_pages(_deal_out(rows, lines))
