"""Every operator as a query over the order tables: (spark, folder) -> DataFrame."""

import datetime as dt

from pyspark.sql import functions as F

from .functions import derived, money
from .operators import merge, predicates, quality, risk, rollups, search, transform
from .operators.predicates import ContractFilter
from .plans import loads, mart_changes, marts
from .schemas import (
    KEY,
    ROW_HASH,
    SUMMARY_COLUMNS,
    UPDATED_AT,
    YEAR,
)
from .session import configure, work_folder
from .sources import lake, newest, order_tables, pages, run_log

# The table as it was at the end of this day is the one a batch is merged into.
SNAPSHOT = dt.date(1999, 12, 31)
WATERMARK = "2000-06-30T00:00:00.000"
AS_OF = dt.date(2001, 6, 30)
YEARS = [1997, 2000]
RISK = {"threshold": 15, "times": 2}

QUERIES = {}


def query(function):
    def run(spark, folder):
        return function(configure(spark), folder)

    run.__name__ = function.__name__
    QUERIES[function.__name__] = run
    return run


_loaded_tables = {}


def gold_root(spark, folder):
    """Where the contracts of the order tables are stored as a loaded table, written once per application."""
    key = spark.sparkContext.applicationId, folder
    if key not in _loaded_tables or not lake.exists(spark, _loaded_tables[key]):
        root = work_folder(spark, "contracts")
        lake.gold_write_full(order_tables.contracts(spark, folder, by_year=True), root, spread=False)
        _loaded_tables[key] = root
    return _loaded_tables[key]


def gold(spark, folder):
    return lake.gold_scan(spark, gold_root(spark, folder))


def holding(spark, folder, column, value, *columns):
    """Stored contracts with one value, from the files that hold it."""
    rows = lake.gold_where(spark, gold_root(spark, folder), column, value)
    return rows.select(*columns) if columns else rows


def contracts(spark, folder, *columns, until=None):
    """Stored contracts; as of an earlier day they are derived from the order tables."""
    if until is not None:
        return order_tables.contracts(spark, folder, list(columns) or None, until)
    return gold(spark, folder).select(*columns) if columns else gold(spark, folder)


def typed(spark, folder, until=None):
    return transform.bronze_to_silver(order_tables.page_rows(spark, folder, until))


ENTITY_LIST = ["nit_entidad", "nombre_entidad", "sector", "departamento", "ciudad", "valor_contrato"]
SUPPLIER_LIST = ["documento_proveedor", "proveedor_adjudicado", "es_pyme", "valor_contrato"]
FILTER_COLUMNS = SUMMARY_COLUMNS + ["nit_entidad", "documento_proveedor", YEAR]


def big(column):
    return F.col(column).cast("bigint").alias(column)


# --- sources and sinks --------------------------------------------------------


@query
def bronze_scan(spark, folder):
    target = work_folder(spark, "pages")
    files = pages.write_pages(order_tables.page_rows(spark, folder), target, compression="gzip")
    return pages.bronze_scan(spark, target, files).select(
        "id_contrato", "nombre_entidad", "fecha_de_firma", "valor_del_contrato", "valor_pagado",
        "localizaci_n", "urlproceso", UPDATED_AT, "n_mero_de_cuenta",
    )


SILVER_VIEW = [KEY, "nombre_entidad", "fecha_firma", "valor_contrato", "valor_pagado", "anio", ROW_HASH]


def _silver_view(rows):
    return rows.select(*[big(c) if c == YEAR else c for c in SILVER_VIEW])


@query
def silver_write(spark, folder):
    target = work_folder(spark, "silver")
    lake.silver_write(typed(spark, folder), target)
    return lake.rows_per_year(lake.silver_scan(spark, target))


@query
def silver_scan(spark, folder):
    target = work_folder(spark, "silver")
    lake.silver_write(typed(spark, folder), target)
    return _silver_view(lake.silver_scan(spark, target))


def _gold(spark, folder, until=None):
    target = work_folder(spark, "gold")
    lake.gold_write_full(order_tables.contracts(spark, folder, until=until, by_year=True), target, spread=False)
    return target


def _year_sums(gold):
    return gold.groupBy(big(YEAR)).agg(
        F.count(F.lit(1)).alias("registros"),
        money.total("valor_contrato").alias("contratado"),
        money.total("valor_pagado").alias("pagado"),
    )


@query
def gold_write_full(spark, folder):
    return lake.rows_per_year(lake.gold_scan(spark, _gold(spark, folder)))


@query
def gold_write_incremental(spark, folder):
    """Years without a change keep the amounts paid until the snapshot."""
    target = _gold(spark, folder, SNAPSHOT)
    lake.gold_write_incremental(contracts(spark, folder), target, YEARS)
    return _year_sums(lake.gold_scan(spark, target))


@query
def gold_view(spark, folder):
    lake.gold_view(spark, _gold(spark, folder))
    return spark.sql(
        "SELECT id_contrato, fecha_firma, valor_contrato, CAST(anio AS BIGINT) AS anio FROM contratos"
    )


@query
def dataset_health(spark, folder):
    return lake.dataset_health(spark, _gold(spark, folder))


def _mart(name):
    return marts.MART[name]


MART_COLUMNS = [
    "nit_entidad", "nombre_entidad", "documento_proveedor", "proveedor_adjudicado",
    "modalidad_contratacion", "fecha_firma", "valor_contrato", YEAR,
]
MART_NEEDS = {
    "mart_entidades": ["nit_entidad", "nombre_entidad", "documento_proveedor", "fecha_firma", "valor_contrato", YEAR],
    "mart_proveedores": ["documento_proveedor", "proveedor_adjudicado", "nit_entidad", "fecha_firma", "valor_contrato", YEAR],
    "mart_temporal": ["fecha_firma", "valor_contrato", YEAR],
    "mart_modalidades": ["modalidad_contratacion", "fecha_firma", "valor_contrato", YEAR],
}


def _mart_rows(spark, folder, mart=None, until=None):
    """Only the columns a mart reads; it would read no more from the stored partitions."""
    needs = MART_NEEDS.get(mart.name, MART_COLUMNS) if mart else MART_COLUMNS
    return contracts(spark, folder, *needs, until=until)


def _out(rows):
    return rows.select(*[big(c) if c in (YEAR, "mes") else c for c in rows.columns])


@query
def mart_write(spark, folder):
    target = work_folder(spark, "marts")
    mart = _mart("mart_temporal")
    marts.mart_write(mart, mart.build(_mart_rows(spark, folder, mart)), target)
    return _out(spark.table("mart_temporal"))


@query
def mart_read(spark, folder):
    target = work_folder(spark, "marts")
    mart = _mart("mart_modalidades")
    marts.mart_write(mart, mart.build(_mart_rows(spark, folder, mart)), target)
    return _out(marts.mart_read(spark, mart, target))


def _runs(spark, folder):
    """One run per signing month: what it would have loaded."""
    month = F.date_format("fecha_firma", "yyyyMM")
    rows = contracts(spark, folder, "fecha_firma", YEAR).where(F.col("fecha_firma").isNotNull())
    return rows.groupBy(month.alias("mes"), F.col(YEAR)).agg(
        F.count(F.lit(1)).alias("n"), F.max("fecha_firma").alias("ultimo")
    ).select(
        F.concat(F.lit("run_"), "mes").alias("run_id"),
        F.date_format("ultimo", order_tables.ISO_TEXT).alias("timestamp"),
        F.col("n").alias("extract_records"),
        F.col("n").alias("inserted_records"),
        F.array(YEAR).alias("years_affected"),
        F.when(F.month("ultimo") == 12, "failed").otherwise("completed").alias("status"),
        F.date_format("ultimo", order_tables.ISO_TEXT).alias("watermark"),
    )


@query
def run_history_append(spark, folder):
    target = work_folder(spark, "runs")
    runs = _runs(spark, folder)
    for status in ("failed", "completed"):
        run_log.run_history_append(runs.where(F.col("status") == status), target)
    return run_log.run_history(spark, target).select(
        "run_id", "timestamp", "extract_records", "inserted_records", "updated_records", "status",
        F.array_join(F.col("years_affected").cast("array<string>"), ",").alias("years_affected"),
    )


@query
def latest_state(spark, folder):
    target = work_folder(spark, "runs")
    run_log.run_history_append(_runs(spark, folder), target)
    history = run_log.run_history(spark, target)
    needed = run_log.full_load_needed(history).scalar()
    return run_log.latest_state(history).select(
        "run_id", "timestamp", "extract_records", "watermark", needed.alias("full_load_needed")
    )


# --- projections and cleaning -------------------------------------------------


@query
def rename_columns(spark, folder):
    rows = transform.rename_columns(order_tables.page_rows(spark, folder))
    return rows.select(
        KEY, "fecha_firma", "valor_contrato", "localizacion", "modalidad_contratacion",
        "es_postconflicto", "n_mero_de_cuenta",
    )


@query
def cast_dates(spark, folder):
    rows = transform.rename_columns(order_tables.page_rows(spark, folder))
    return transform.cast_dates(rows).select(KEY, "fecha_firma", "fecha_inicio", "fecha_fin")


@query
def cast_money(spark, folder):
    rows = transform.rename_columns(order_tables.page_rows(spark, folder))
    return transform.cast_money(rows).select(KEY, "valor_contrato", "valor_pagado", "valor_facturado")


@query
def clean_strings(spark, folder):
    rows = transform.clean_strings(order_tables.page_rows(spark, folder))
    return rows.select(KEY, "nombre_entidad", "localizaci_n", "objeto_del_contrato")


@query
def extract_year(spark, folder):
    rows = transform.rename_columns(order_tables.page_rows(spark, folder))
    return transform.extract_year(transform.cast_dates(rows)).select(KEY, big(YEAR))


@query
def row_hash(spark, folder):
    rows = order_tables.page_rows(spark, folder)
    names = [KEY, "nombre_entidad", "fecha_de_firma", "valor_del_contrato", "valor_pagado", "saldo_cdp"]
    return transform.row_hash(rows, names).select(KEY, ROW_HASH)


@query
def bronze_to_silver(spark, folder):
    return _out(typed(spark, folder))


@query
def url_unwrap(spark, folder):
    return transform.url_unwrap(contracts(spark, folder, KEY, "url_proceso"))


@query
def contract_summary(spark, folder):
    return search.contract_summary(contracts(spark, folder, *SUMMARY_COLUMNS))


@query
def contract_detail(spark, folder):
    return search.contract_detail(contracts(spark, folder))


@query
def execution_pct(spark, folder):
    paid, value = F.col("valor_pagado"), F.col("valor_contrato")
    return contracts(spark, folder, KEY, "valor_pagado", "valor_contrato").select(
        KEY,
        derived.execution_pct(paid, value).alias("ejecucion_pct"),
        derived.execution_bar(paid, value).alias("barra_pct"),
    )


@query
def high_value_flag(spark, folder):
    """Order values are taken as units of 20 000 pesos, so that some pass the limit."""
    pesos = F.col("valor_contrato") * 20_000
    return contracts(spark, folder, KEY, "valor_contrato").select(
        KEY, derived.is_high_value(pesos).alias("valor_alto")
    )


@query
def status_class(spark, folder):
    return contracts(spark, folder, KEY, "estado_contrato").select(
        KEY, "estado_contrato", derived.status_class(F.col("estado_contrato")).alias("clase")
    )


@query
def supplier_concentration_level(spark, folder):
    return rollups.supplier_concentration(contracts(spark, folder, *SUPPLIER_LIST))


# The salt of the registered example; a real projection takes a secret one.
EXAMPLE_SALT = "ejemplo-"


@query
def public_projection(spark, folder):
    rows = contracts(spark, folder, KEY, "documento_proveedor", "valor_contrato", "fecha_firma")
    kept = transform.public_projection(rows).columns
    return rows.select(*kept, transform.pseudonym(F.col("documento_proveedor"), EXAMPLE_SALT).alias("seudonimo"))


# --- filters ------------------------------------------------------------------


def _filtered(**conditions):
    def run(spark, folder):
        rows = contracts(spark, folder, *FILTER_COLUMNS)
        return search.contract_summary(ContractFilter(**conditions).apply(rows))

    return run


FILTERS = {
    "filter_year": {"anio": 1998},
    "filter_entity": {"entidad": "nation_1"},
    "filter_supplier": {"proveedor": "customer#00000007"},
    "filter_modality": {"modalidad": "1-URGENT"},
    "filter_date_range": {
        "fecha_desde": dt.date(1996, 3, 1),
        "fecha_hasta": dt.date(1997, 2, 28),
    },
    "filter_value_range": {"valor_min": 100000.0, "valor_max": 250000.5},
    "filter_combined": {
        "anio": 1999,
        "entidad": "nation_2",
        "modalidad": "2-HIGH",
        "fecha_desde": dt.date(1999, 2, 1),
        "valor_min": 0.0,
        "valor_max": 300000.0,
        "proveedor": "",
    },
}
for _name, _conditions in FILTERS.items():
    _run = _filtered(**_conditions)
    _run.__name__ = _name
    query(_run)


@query
def search_entities(spark, folder):
    return rollups.entity_list(contracts(spark, folder, *ENTITY_LIST), "tion_1")


@query
def search_suppliers(spark, folder):
    return rollups.supplier_list(contracts(spark, folder, *SUPPLIER_LIST), "#00000001")


@query
def lookup_contract(spark, folder):
    return search.lookup_contract(holding(spark, folder, KEY, "42"), "42")


@query
def lookup_entity(spark, folder):
    return rollups.entity_detail(holding(spark, folder, "nit_entidad", "7", *ENTITY_LIST), "7")


@query
def lookup_supplier(spark, folder):
    return rollups.supplier_detail(holding(spark, folder, "documento_proveedor", "11", *SUPPLIER_LIST), "11")


@query
def watermark_filter(spark, folder):
    return predicates.updated_since(contracts(spark, folder, KEY, UPDATED_AT), WATERMARK)


@query
def years_filter(spark, folder):
    return _out(contracts(spark, folder, KEY, YEAR).where(predicates.years_in(YEARS)))


@query
def not_null_guards(spark, folder):
    rows = contracts(spark, folder, *MART_COLUMNS, "localizacion")
    guards = {
        "mart_entidades": ("nit_entidad", "nombre_entidad", "fecha_firma"),
        "mart_proveedores": ("documento_proveedor", "proveedor_adjudicado", "fecha_firma"),
        "mart_temporal": ("fecha_firma",),
        "mart_modalidades": ("modalidad_contratacion", "fecha_firma"),
        "por_localidad": ("localizacion",),
        "modalidades": ("modalidad_contratacion",),
    }
    return rows.agg(*[F.count_if(predicates.present(*c)).alias(n) for n, c in guards.items()])


@query
def row_count_guard(spark, folder):
    return quality.row_count_guard(
        contracts(spark, folder, KEY), contracts(spark, folder, KEY, until=SNAPSHOT)
    )


@query
def silver_validate(spark, folder):
    return quality.silver_validate(contracts(spark, folder, KEY, YEAR))


@query
def mart_validate(spark, folder):
    checks = [
        quality.mart_violations(mart.name, mart.build(_mart_rows(spark, folder, mart)))
        for mart in marts.MARTS
    ]
    return merge.union_all(*checks)


@query
def quality_report(spark, folder):
    return quality.quality_report(contracts(spark, folder, *SUMMARY_COLUMNS))


@query
def cast_failure_report(spark, folder):
    return quality.cast_failure_report(order_tables.page_rows(spark, folder))


@query
def quality_rules(spark, folder):
    """Over the shipment feed, where a contract comes once per shipment."""
    return quality.quality_rules(transform.bronze_to_silver(order_tables.shipment_feed(spark, folder)))


# --- merge --------------------------------------------------------------------


def _merge_input(spark, folder):
    return typed(spark, folder, SNAPSHOT), typed(spark, folder)


MERGE_VIEW = [KEY, "valor_pagado", "fecha_firma", "anio", ROW_HASH]


def _merge_view(rows):
    return rows.select(*[big(c) if c == YEAR else c for c in MERGE_VIEW])


@query
def merge_inserts(spark, folder):
    return _merge_view(merge.merge_inserts(*_merge_input(spark, folder)))


@query
def merge_updates(spark, folder):
    return _merge_view(merge.merge_updates(*_merge_input(spark, folder)))


@query
def merge_unchanged(spark, folder):
    return _merge_view(merge.merge_unchanged(*_merge_input(spark, folder)))


@query
def merge_silver(spark, folder):
    return _merge_view(merge.merge_silver(*_merge_input(spark, folder)))


@query
def merge_metrics(spark, folder):
    existing, batch = _merge_input(spark, folder)
    return merge.merge_metrics(merge.classify(existing, merge.latest_versions(batch)))


@query
def latest_versions(spark, folder):
    feed = transform.bronze_to_silver(order_tables.shipment_feed(spark, folder))
    return merge.latest_versions(feed).select(KEY, UPDATED_AT, "valor_facturado", ROW_HASH)


@query
def gold_partition_upsert(spark, folder):
    """Columns differ on purpose: the incoming rows know no sector, the existing ones no payments."""
    existing = contracts(spark, folder, KEY, "valor_contrato", "sector", until=SNAPSHOT)
    updated = contracts(spark, folder, KEY, "valor_contrato", "valor_pagado", UPDATED_AT)
    return lake.gold_partition_upsert(
        existing, predicates.updated_since(updated, WATERMARK).drop(UPDATED_AT)
    )


@query
def contractor_stats_join(spark, folder):
    rows = contracts(spark, folder, KEY, risk.SUPPLIER, "valor_contrato")
    return risk.contractor_stats_join(rows).select(KEY, risk.SUPPLIER, risk.COUNT, risk.MEAN)


def _modality_totals(spark, folder):
    return marts.modality_totals(_mart_rows(spark, folder, _mart("mart_modalidades")))


@query
def year_total_join(spark, folder):
    return _out(marts.year_total_join(_modality_totals(spark, folder)))


@query
def union_all(spark, folder):
    """Inserts and updates of a batch; table and batch are stored first, so each is made once."""
    stored = []
    states = order_tables.page_rows_twice(spark, folder, SNAPSHOT, work_folder(spark, "orders"))
    for purpose, rows in zip(("existing", "batch"), states, strict=True):
        path = work_folder(spark, purpose)
        transform.bronze_to_silver(rows).select(*MERGE_VIEW, UPDATED_AT).write.parquet(path)
        stored.append(spark.read.parquet(path))
    return merge.union_all(_merge_view(merge.merge_inserts(*stored)), _merge_view(merge.merge_updates(*stored)))


@query
def union_relaxed(spark, folder):
    years = contracts(spark, folder, KEY, YEAR, "ciudad").withColumnRenamed(YEAR, "valor_contrato")
    return merge.union_relaxed(contracts(spark, folder, KEY, "valor_contrato", "sector"), years)


@query
def key_difference(spark, folder):
    existing, batch = _merge_input(spark, folder)
    return merge.key_difference(batch, existing)


@query
def key_intersection(spark, folder):
    existing, batch = _merge_input(spark, folder)
    return merge.key_intersection(batch, existing)


def _loaded(spark, target):
    return _year_sums(target.scan(spark, lake.GOLD))


@query
def full_load(spark, folder):
    """Pages to typed table, yearly partitions, marts and run history."""
    target = loads.Lake(work_folder(spark, "lake"))
    loads.load_full(spark, order_tables.page_rows(spark, folder), target)
    return _loaded(spark, target)


@query
def incremental_load(spark, folder):
    """A full load of the snapshot, then everything updated since as a batch."""
    target = loads.Lake(work_folder(spark, "lake"))
    snapshot, today = order_tables.page_rows_twice(spark, folder, SNAPSHOT, work_folder(spark, "orders"))
    loads.load_full(spark, snapshot, target)
    since = (SNAPSHOT + dt.timedelta(days=1)).isoformat()
    loads.load_batch(spark, today, target, since)
    return _loaded(spark, target)


# --- aggregates ---------------------------------------------------------------

ROLLUPS = {
    rollups.kpi: ["valor_contrato", "proveedor_adjudicado", "nombre_entidad", "localizacion"],
    rollups.top_contractors: ["proveedor_adjudicado", "valor_contrato"],
    rollups.count_unique_contractors: ["proveedor_adjudicado"],
    rollups.by_locality: ["valor_contrato", "proveedor_adjudicado", "nombre_entidad", "localizacion"],
    rollups.count_localities: ["localizacion"],
    rollups.modalities: ["modalidad_contratacion", "valor_contrato"],
    rollups.count_contracts: [KEY],
    rollups.count_entities: ["nit_entidad"],
    rollups.count_suppliers: ["documento_proveedor"],
    rollups.total_values: ["valor_contrato", "valor_pagado"],
    rollups.year_range: ["fecha_firma"],
    rollups.entity_list: ENTITY_LIST,
    rollups.entity_count: ["nit_entidad", "nombre_entidad"],
    rollups.supplier_list: SUPPLIER_LIST,
    rollups.supplier_count: ["documento_proveedor", "proveedor_adjudicado"],
    rollups.available_years: ["fecha_firma", YEAR],
    rollups.yearly_totals: ["fecha_firma", "valor_contrato"],
    rollups.yearly_contracted_vs_paid: ["fecha_firma", "valor_contrato", "valor_pagado", YEAR],
    rollups.entity_execution: ["nit_entidad", "nombre_entidad", "valor_contrato", "valor_pagado"],
    rollups.entity_kpis: ["nit_entidad", "nombre_entidad", "valor_contrato", "valor_pagado"],
    rollups.entity_modality_breakdown: ["nit_entidad", "modalidad_contratacion", "valor_contrato"],
    rollups.entity_top_suppliers: [
        "nit_entidad", "documento_proveedor", "proveedor_adjudicado", "valor_contrato",
    ],
    rollups.supplier_kpis: ["documento_proveedor", "es_pyme"],
}


def _rollup(function, columns):
    def run(spark, folder):
        return function(contracts(spark, folder, *columns))

    run.__name__ = function.__name__
    return query(run)


for _function, _columns in ROLLUPS.items():
    _rollup(_function, _columns)


@query
def stats_overview(spark, folder):
    rows = contracts(
        spark, folder, "nit_entidad", "documento_proveedor", "valor_contrato", "valor_pagado",
        "fecha_firma", UPDATED_AT,
    )
    return rollups.stats_overview(rows)


@query
def entity_detail(spark, folder):
    return rollups.entity_detail(contracts(spark, folder, *ENTITY_LIST), "3")


@query
def supplier_detail(spark, folder):
    return rollups.supplier_detail(contracts(spark, folder, *SUPPLIER_LIST), "25")


@query
def contract_count(spark, folder):
    return search.contract_count(contracts(spark, folder, "modalidad_contratacion"), ContractFilter(modalidad="5-LOW"))


@query
def unpaid_over_12_months(spark, folder):
    rows = contracts(spark, folder, KEY, "fecha_firma", "valor_pagado")
    return rollups.unpaid_over_12_months(rows, AS_OF)


@query
def new_watermark(spark, folder):
    return merge.new_watermark(contracts(spark, folder, UPDATED_AT), WATERMARK)


@query
def affected_years(spark, folder):
    existing, batch = _merge_input(spark, folder)
    changes = merge.classify(existing, merge.latest_versions(batch))
    return _out(merge.affected_years(changes))


# --- marts --------------------------------------------------------------------

def _mart_full(mart):
    def run(spark, folder):
        return _out(mart.build(_mart_rows(spark, folder, mart)))

    run.__name__ = mart.name
    return query(run)


def _mart_states(spark, folder, mart):
    """The contracts as of the snapshot and all of them, with the columns a mart reads.

    Neither needs line items, so storing whole contracts for the second would
    cost several times what the marts do.
    """
    needs = MART_NEEDS[mart.name]
    return order_tables.contracts(spark, folder, needs, SNAPSHOT), order_tables.contracts(spark, folder, needs)


def _mart_incremental(mart):
    """Built from the snapshot, then only some years from all contracts."""

    def run(spark, folder):
        target = work_folder(spark, "marts")
        before, after = _mart_states(spark, folder, mart)
        marts.mart_write(mart, mart.build(before), target)
        marts.mart_incremental(mart, after, target, YEARS)
        return _out(spark.table(mart.name))

    run.__name__ = f"{mart.name}_incremental"
    return query(run)


def _mart_difference(mart):
    """Built from the snapshot, then brought up to date by the contracts that differ from it."""

    def run(spark, folder):
        target = work_folder(spark, "marts")
        before, after = _mart_states(spark, folder, mart)
        marts.mart_start(mart, before, target)
        # Contracts on both sides cancel out when they are counted.
        marts.mart_change(mart, mart_changes.weighted(before, after), target)
        return _out(spark.table(mart.name))

    run.__name__ = f"{mart.name}_difference"
    return query(run)


for _each in marts.MARTS:
    _mart_full(_each)
    _mart_incremental(_each)
    _mart_difference(_each)


@query
def participation_pct(spark, folder):
    return _out(marts.participation_pct(_modality_totals(spark, folder)))


@query
def build_marts(spark, folder):
    target = work_folder(spark, "marts")
    marts.build_marts(_mart_rows(spark, folder), target)
    counts = [
        spark.table(mart.name).agg(F.lit(mart.name).alias("mart"), F.count(F.lit(1)).alias("filas"))
        for mart in marts.MARTS
    ]
    return merge.union_all(*counts)


@query
def mart_sort(spark, folder):
    """The stored mart with the place of each row in its file; years this small have one file."""
    target = work_folder(spark, "marts")
    mart = _mart("mart_proveedores")
    marts.mart_write(mart, mart.build(_mart_rows(spark, folder)), target)
    rows = marts.mart_read(spark, mart, target)
    return _out(rows.select("*", F.col("_metadata.row_index").alias("posicion")))


# --- pages and lists ----------------------------------------------------------


@query
def contracts_page(spark, folder):
    return newest.gold_page(spark, gold_root(spark, folder), ContractFilter(), page=3)


@query
def contracts_page_filtered(spark, folder):
    filters = ContractFilter(entidad="tion_1", valor_min=1000.0)
    return newest.gold_page(spark, gold_root(spark, folder), filters, page=2)


@query
def contracts_page_after(spark, folder):
    return search.contracts_page_after(
        contracts(spark, folder, *SUMMARY_COLUMNS, YEAR), ContractFilter(), dt.date(2000, 5, 5), "5"
    )


@query
def entity_page(spark, folder):
    return search.entity_page(contracts(spark, folder, *ENTITY_LIST), page=2, size=10)


@query
def supplier_page(spark, folder):
    return search.supplier_page(contracts(spark, folder, *SUPPLIER_LIST), page=2, size=25)


@query
def entity_recent_contracts(spark, folder):
    return newest.gold_recent(spark, gold_root(spark, folder), "nit_entidad", "4")


@query
def supplier_recent_contracts(spark, folder):
    return newest.gold_recent(spark, gold_root(spark, folder), "documento_proveedor", "17")


@query
def recent_contracts_all(spark, folder):
    return search.recent_contracts_all(
        contracts(spark, folder, *SUMMARY_COLUMNS, "nit_entidad"), "nit_entidad"
    )


@query
def recent_contracts_all_suppliers(spark, folder):
    return search.recent_contracts_all(
        contracts(spark, folder, *SUMMARY_COLUMNS, "documento_proveedor"), "documento_proveedor"
    )


# --- risk ---------------------------------------------------------------------


def _risk_rows(spark, folder):
    return contracts(
        spark, folder, KEY, "proceso_de_compra", risk.SUPPLIER, "nombre_entidad", "valor_contrato"
    )


@query
def risk_contracts(spark, folder):
    rows = risk.risk_contracts(_risk_rows(spark, folder), **RISK)
    return rows.withColumn("indicadores", F.array_join("indicadores", "; "))


@query
def risk_contracts_default(spark, folder):
    rows = risk.risk_contracts(_risk_rows(spark, folder))
    return rows.withColumn("indicadores", F.array_join("indicadores", "; "))


@query
def risk_indicators(spark, folder):
    rows = risk.risk_indicators(risk.flagged(_risk_rows(spark, folder), **RISK), **RISK)
    return rows.select(KEY, F.array_join("indicadores", "; ").alias("indicadores"))


@query
def risk_level(spark, folder):
    rows = risk.risk_level(
        risk.risk_indicators(risk.flagged(_risk_rows(spark, folder), **RISK), **RISK)
    )
    return rows.groupBy("nivel_riesgo").agg(F.count(F.lit(1)).alias("contratos"))


@query
def risk_summary(spark, folder):
    return risk.risk_summary(_risk_rows(spark, folder), **RISK)


@query
def risk_type(spark, folder):
    return risk.risk_types(_risk_rows(spark, folder), **RISK)
