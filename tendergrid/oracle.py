"""The same queries as plain SQL over the same tables, to check the results against."""

from .catalog import (
    AS_OF,
    FILTERS,
    RISK,
    SNAPSHOT,
    WATERMARK,
    YEARS,
)
from .functions.cleaning import WHITESPACE
from .schemas import PAGE_BUSINESS_COLUMNS, SILVER_COLUMNS

YEAR_LIST = ", ".join(str(year) for year in YEARS)


def contracts(name="c", until=None, payments=False):
    """The contract table as a list of common table expressions."""
    orders = f" WHERE CAST(o_orderdate AS DATE) <= DATE '{until}'" if until else ""
    lines = f" WHERE CAST(l_shipdate AS DATE) <= DATE '{until}'" if until else ""
    billed = f"""{name}_billed AS (
      SELECT l_orderkey,
        CAST(ROUND(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2))
          * (1 - CAST(l_discount AS DECIMAL(4,2))) END), 2) AS DOUBLE) AS pagado,
        CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS facturado,
        CAST(MIN(l_shipdate) AS DATE) AS primera, CAST(MAX(l_shipdate) AS DATE) AS ultima,
        COUNT(*) AS lineas
      FROM lineitem{lines} GROUP BY l_orderkey),
    """
    paid = """,
        primera AS fecha_inicio, ultima AS fecha_fin,
        CAST(date_diff('day', primera, ultima) AS VARCHAR) || ' Dia(s)' AS duracion_contrato,
        CAST(lineas AS VARCHAR) AS dias_adicionados, facturado AS valor_facturado,
        pagado AS valor_pagado,
        strftime(GREATEST(CAST(o_orderdate AS DATE), COALESCE(ultima, CAST(o_orderdate AS DATE))),
          '%Y-%m-%dT00:00:00.000') AS ultima_actualizacion"""
    return f"""{billed if payments else ""}{name}_signed AS (
      SELECT *, CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED')
        THEN CAST(o_orderdate AS DATE) END AS fecha_firma
      FROM orders{orders}),
    {name} AS (
      SELECT CAST(o_orderkey AS VARCHAR) AS id_contrato, fecha_firma,
        'PROC.' || CAST(o_orderkey AS VARCHAR) AS proceso_de_compra,
        CASE o_orderstatus WHEN 'O' THEN 'En ejecución' WHEN 'P' THEN 'Suspendido'
          ELSE 'Cerrado' END AS estado_contrato,
        CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
          THEN CAST(o_custkey AS VARCHAR) END AS documento_proveedor,
        CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
          THEN o_totalprice END AS valor_contrato,
        CASE WHEN NOT (o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM')
          THEN o_orderpriority END AS modalidad_contratacion,
        'Ejecutivo' AS rama, 'Distribuido' AS origen_recursos, 'Inversión' AS destino_gasto,
        'No' AS es_postconflicto, 'Suministro | ' || CAST(o_orderkey AS VARCHAR) AS objeto_contrato,
        '{{"url":"https://example.org/' || CAST(o_orderkey AS VARCHAR) || '"}}' AS url_proceso,
        COALESCE(YEAR(fecha_firma), 0) AS anio,
        CASE WHEN c_acctbal >= -800 THEN c_name END AS proveedor_adjudicado,
        c_mktsegment AS sector, 'Suministro ' || c_mktsegment AS tipo_contrato,
        CASE WHEN c_acctbal < 2500 THEN 'Si' ELSE 'No' END AS es_pyme,
        CASE WHEN NOT (c_nationkey = 24 AND c_acctbal < 0)
          THEN CAST(c_nationkey AS VARCHAR) END AS nit_entidad,
        n_name AS nombre_entidad, n_name AS ciudad, r_name AS departamento,
        CASE WHEN NOT (c_mktsegment = 'HOUSEHOLD' AND n_nationkey = 0) THEN r_name END AS localizacion
        {paid if payments else ""}
      FROM {name}_signed
      LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey
      {f"LEFT JOIN {name}_billed ON o_orderkey = l_orderkey" if payments else ""})"""


# Columns of the landing text that are not NULL throughout, from columns of the contract table.
_FILLED = """id_contrato nombre_entidad nit_entidad departamento ciudad sector rama proceso_de_compra
estado_contrato documento_proveedor destino_gasto localizacion modalidad_contratacion tipo_contrato
objeto_contrato fecha_firma fecha_inicio fecha_fin duracion_contrato dias_adicionados
proveedor_adjudicado es_pyme valor_contrato valor_facturado valor_pagado origen_recursos url_proceso
es_postconflicto""".split()


def landed(name, source, filled=None):
    """The contract table as landing text."""
    parts = []
    for silver, page, kind in SILVER_COLUMNS:
        if silver not in (filled or _FILLED):
            value = "CAST(NULL AS VARCHAR)"
        elif kind == "date":
            value = f"strftime({silver}, '%Y-%m-%dT00:00:00.000')"
        elif kind == "money":
            value = f"CAST(CAST({silver} AS DECIMAL(18,2)) AS VARCHAR)"
        else:
            value = silver
        if silver == "nombre_entidad":
            value = f"'  ' || {value} || ' ' || chr(9)"
        elif silver == "fecha_firma":
            value = f"COALESCE({value}, 'NO DEFINIDO')"
        elif silver == "valor_contrato":
            value = f"COALESCE('$ ' || {value}, 'N/A')"
        parts.append(f"{value} AS {page}")
    return f"{name} AS (SELECT {', '.join(parts)}, ultima_actualizacion FROM {source})"


_SPACES = " || ".join(f"chr({ord(character)})" for character in WHITESPACE)


def _date(text):
    head = f"SUBSTR({text}, 1, 10)"
    return (
        f"CASE WHEN regexp_full_match({head}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') "
        f"THEN TRY_CAST({head} AS DATE) END"
    )


def _money(text):
    return f"TRY_CAST(REGEXP_REPLACE({text}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def _hash(columns):
    return "sha256(" + " || '|' || ".join(f"COALESCE({c}, '')" for c in columns) + ")"


def typed(name, source):
    """Landing text as the typed table."""
    parts = []
    for silver, page, kind in SILVER_COLUMNS:
        value = {
            "text": f"TRIM({page}, {_SPACES})",
            "date": _date(page),
            "money": _money(page),
            "url": f"TRIM(COALESCE(CASE WHEN json_valid({page}) "
            f"THEN json_extract_string({page}, '$.url') END, {page}), {_SPACES})",
        }[kind]
        parts.append(f"{value} AS {silver}")
    return f"""{name} AS (SELECT {', '.join(parts)}, TRIM(ultima_actualizacion, {_SPACES}) AS ultima_actualizacion,
      COALESCE(YEAR({_date('fecha_de_firma')}), 0) AS anio,
      {_hash(PAGE_BUSINESS_COLUMNS)} AS row_hash FROM {source})"""


def total(column="valor_contrato"):
    return f"CAST(SUM(CAST({column} AS DECIMAL(28,2))) AS DOUBLE)"


def zero(column="valor_contrato"):
    return f"COALESCE({total(column)}, 0)"


def mean(column="valor_contrato"):
    return f"({total(column)} / NULLIF(COUNT({column}), 0))"


def pct(part, whole):
    return f"(({part}) / NULLIF({whole}, 0) * 100.0)"


C = "WITH " + contracts()
P = "WITH " + contracts(payments=True)
LANDED = P + ", " + landed("b", "c")
TYPED = LANDED + ", " + typed("s", "b")
FEED = (
    C
    + """, v AS (SELECT c.* EXCLUDE (departamento), l_extendedprice AS valor_facturado,
      strftime(CAST(l_shipdate AS DATE), '%Y-%m-%dT00:00:00.000') AS ultima_actualizacion
      FROM c JOIN lineitem ON id_contrato = CAST(l_orderkey AS VARCHAR)), """
    + landed(
        "b", "v",
        ["id_contrato", "nombre_entidad", "nit_entidad", "fecha_firma", "valor_contrato", "valor_facturado"],
    )
    + ", "
    + typed("s", "b")
)
MERGE = (
    "WITH "
    + ", ".join(
        [
            contracts("o", SNAPSHOT, True),
            landed("ob", "o"),
            typed("e", "ob"),
            contracts("n", None, True),
            landed("nb", "n"),
            typed("i", "nb"),
        ]
    )
)
MERGE_COLUMNS = "i.id_contrato, i.valor_pagado, i.fecha_firma, i.anio, i.row_hash"
OLDER = "COALESCE(i.ultima_actualizacion < e.ultima_actualizacion, FALSE)"
INSERTS = f"SELECT {MERGE_COLUMNS} FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id_contrato = i.id_contrato)"
UPDATES = f"SELECT {MERGE_COLUMNS} FROM i JOIN e ON e.id_contrato = i.id_contrato WHERE e.row_hash <> i.row_hash"

SUMMARY = (
    "id_contrato, nombre_entidad, proveedor_adjudicado, valor_contrato, fecha_firma, "
    "estado_contrato, modalidad_contratacion"
)
N = "COUNT(*) AS total_contratos"
SUM = f"{total()} AS valor_total"


def mart_sql(name, source="c", where="TRUE"):
    signed = f"fecha_firma IS NOT NULL AND {where}"
    bodies = {
        "mart_entidades": f"""SELECT nit_entidad, MAX(nombre_entidad) AS nombre_entidad, anio, {N}, {SUM},
            {mean()} AS valor_promedio, MAX(valor_contrato) AS valor_maximo,
            MIN(valor_contrato) AS valor_minimo,
            COUNT(DISTINCT documento_proveedor) AS proveedores_unicos
          FROM {source} WHERE nit_entidad IS NOT NULL AND nombre_entidad IS NOT NULL AND {signed}
          GROUP BY nit_entidad, anio""",
        "mart_proveedores": f"""SELECT documento_proveedor, MAX(proveedor_adjudicado) AS proveedor, anio,
            {N}, {SUM}, {mean()} AS valor_promedio, COUNT(DISTINCT nit_entidad) AS entidades_unicas
          FROM {source} WHERE documento_proveedor IS NOT NULL AND proveedor_adjudicado IS NOT NULL
            AND {signed} GROUP BY documento_proveedor, anio""",
        "mart_temporal": f"""SELECT anio, MONTH(fecha_firma) AS mes, {N}, {SUM}, {mean()} AS valor_promedio
          FROM {source} WHERE {signed} GROUP BY anio, MONTH(fecha_firma)""",
        "mart_modalidades": f"""SELECT g.*, {pct('valor_total', 'total_anio')} AS participacion_pct FROM (
            SELECT modalidad_contratacion AS modalidad, anio, {N}, {SUM} FROM {source}
            WHERE modalidad_contratacion IS NOT NULL AND {signed}
            GROUP BY modalidad_contratacion, anio) g
          JOIN (SELECT anio AS y, {total()} AS total_anio FROM {source}
            WHERE modalidad_contratacion IS NOT NULL AND {signed} GROUP BY anio) t ON t.y = g.anio""",
    }
    return bodies[name]


MARTS = ["mart_entidades", "mart_proveedores", "mart_temporal", "mart_modalidades"]


def mart_incremental(name):
    both = "WITH " + contracts("c") + ", " + contracts("o", SNAPSHOT)
    return f"""{both} {mart_sql(name, 'o', f'anio NOT IN ({YEAR_LIST})')}
      UNION ALL {mart_sql(name, 'c', f'anio IN ({YEAR_LIST})')}"""


MODALITY = f"""SELECT modalidad_contratacion AS modalidad, anio, {N}, {SUM} FROM c
  WHERE modalidad_contratacion IS NOT NULL AND fecha_firma IS NOT NULL
  GROUP BY modalidad_contratacion, anio"""

def flagged(threshold, times):
    return f"""{C}, cs AS (SELECT proveedor_adjudicado AS p, COUNT(*) AS n, {mean()} AS m
      FROM c WHERE proveedor_adjudicado IS NOT NULL GROUP BY proveedor_adjudicado),
    f AS (SELECT c.*, n, m FROM c JOIN cs ON c.proveedor_adjudicado = p
      WHERE n > {threshold} OR valor_contrato > m * {times}),
    g AS (SELECT *, COALESCE(n > {threshold}, FALSE) AS many,
      COALESCE(valor_contrato > m * {times} AND m <> 0 AND valor_contrato <> 0, FALSE) AS odd FROM f)"""


MANY_TEXT = "'Alta concentración: ' || CAST(n AS VARCHAR) || ' contratos'"
ODD_TEXT = "'Valor atípico frente al promedio del contratista'"
INDICATORS = f"concat_ws('; ', CASE WHEN many THEN {MANY_TEXT} END, CASE WHEN odd THEN {ODD_TEXT} END)"
LEVEL = "CASE CAST(many AS INT) + CAST(odd AS INT) WHEN 2 THEN 'alto' WHEN 1 THEN 'medio' ELSE 'bajo' END"
RISK_ROWS = f"""SELECT id_contrato, proceso_de_compra AS proceso_id, proveedor_adjudicado AS contratista,
  nombre_entidad AS entidad, COALESCE(valor_contrato, 0) AS valor_contrato,
  {LEVEL} AS nivel_riesgo, {INDICATORS} AS indicadores FROM g"""


def _condition(name):
    f = FILTERS[name]
    parts = []
    if f.get("anio"):
        parts.append(f"YEAR(fecha_firma) = {f['anio']}")
    if f.get("entidad"):
        parts.append(f"(nombre_entidad ILIKE '%{f['entidad']}%' OR nit_entidad = '{f['entidad']}')")
    if f.get("proveedor"):
        parts.append(
            f"(proveedor_adjudicado ILIKE '%{f['proveedor']}%' OR documento_proveedor = '{f['proveedor']}')"
        )
    if f.get("modalidad"):
        parts.append(f"modalidad_contratacion = '{f['modalidad']}'")
    if f.get("fecha_desde"):
        parts.append(f"fecha_firma >= DATE '{f['fecha_desde']}'")
    if f.get("fecha_hasta"):
        parts.append(f"fecha_firma <= DATE '{f['fecha_hasta']}'")
    if f.get("valor_min") is not None:
        parts.append(f"valor_contrato >= {f['valor_min']}")
    if f.get("valor_max") is not None:
        parts.append(f"valor_contrato <= {f['valor_max']}")
    return " AND ".join(parts)


RUNS = f"""{C}, r AS (SELECT 'run_' || strftime(fecha_firma, '%Y%m') AS run_id, anio,
    strftime(MAX(fecha_firma), '%Y-%m-%dT00:00:00.000') AS "timestamp", COUNT(*) AS n,
    CASE WHEN MONTH(MAX(fecha_firma)) = 12 THEN 'failed' ELSE 'completed' END AS status
  FROM c WHERE fecha_firma IS NOT NULL GROUP BY strftime(fecha_firma, '%Y%m'), anio)"""

ENTITY = f"""SELECT nit_entidad, MAX(nombre_entidad) AS nombre_entidad, {N}, {SUM}, MAX(sector) AS sector
  FROM c WHERE nit_entidad IS NOT NULL AND nombre_entidad IS NOT NULL"""
ENTITY_DETAIL = f"""SELECT nit_entidad, MAX(nombre_entidad) AS nombre_entidad, {N}, {SUM},
  MAX(sector) AS sector, MAX(departamento) AS departamento, MAX(ciudad) AS ciudad FROM c"""
SUPPLIER_COLUMNS = f"""SELECT documento_proveedor, MAX(proveedor_adjudicado) AS proveedor_adjudicado,
  {N}, {SUM}, MAX(es_pyme) AS es_pyme FROM c"""
SUPPLIER = (
    SUPPLIER_COLUMNS
    + " WHERE documento_proveedor IS NOT NULL AND proveedor_adjudicado IS NOT NULL"
)
NEWEST = "ORDER BY fecha_firma DESC NULLS LAST, id_contrato"


def _ranked(by):
    names = SUMMARY if by in SUMMARY.split(", ") else f"{by}, {SUMMARY}"
    return f"""{C}, w AS (SELECT {names}, ROW_NUMBER() OVER (PARTITION BY {by} {NEWEST}) AS puesto
      FROM c WHERE {by} IS NOT NULL) SELECT * FROM w WHERE puesto <= 10"""


def _count_if(condition, name):
    return f"COUNT(*) FILTER (WHERE {condition}) AS {name}"


LOST = [
    (silver, page, _date(page) if kind == "date" else _money(page))
    for silver, page, kind in SILVER_COLUMNS
    if kind in ("date", "money")
]

EXECUTION = f"""SELECT nit_entidad, MAX(nombre_entidad) AS nombre_entidad, COUNT(*) AS n,
    {zero()} AS contratado, {zero('valor_pagado')} AS pagado FROM c WHERE nit_entidad IS NOT NULL
    GROUP BY nit_entidad"""
EXECUTION_PCT = pct("pagado", "contratado")
SHARE = "CASE WHEN valor_pagado <> 0 AND valor_contrato <> 0 THEN CAST(FLOOR(valor_pagado / valor_contrato * 100 + 0.5) AS BIGINT) END"

LOADED = f"""{P} SELECT anio, COUNT(*) AS registros, {total()} AS contratado,
  {total('valor_pagado')} AS pagado FROM c GROUP BY anio"""

SQL = {
    # sources and sinks
    "bronze_scan": f"""{LANDED} SELECT id_contrato, nombre_entidad, fecha_de_firma, valor_del_contrato,
      valor_pagado, localizaci_n, urlproceso, ultima_actualizacion,
      CAST(NULL AS VARCHAR) AS n_mero_de_cuenta FROM b""",
    "silver_write": f"{C} SELECT anio, COUNT(*) AS registros FROM c GROUP BY anio",
    "silver_scan": f"""{TYPED} SELECT id_contrato, nombre_entidad, fecha_firma, valor_contrato,
      valor_pagado, anio, row_hash FROM s""",
    "gold_write_full": f"{C} SELECT anio, COUNT(*) AS registros FROM c GROUP BY anio",
    "gold_write_incremental": f"""WITH {contracts("c", None, True)}, {contracts("o", SNAPSHOT, True)},
      u AS (SELECT anio, valor_contrato, valor_pagado FROM o WHERE anio NOT IN ({YEAR_LIST})
        UNION ALL SELECT anio, valor_contrato, valor_pagado FROM c WHERE anio IN ({YEAR_LIST}))
      SELECT anio, COUNT(*) AS registros, {total()} AS contratado, {total('valor_pagado')} AS pagado
      FROM u GROUP BY anio""",
    "gold_view": f"{C} SELECT id_contrato, fecha_firma, valor_contrato, anio FROM c",
    # Years this small are written as one file each.
    "dataset_health": f"{C} SELECT COUNT(DISTINCT anio) AS parquet_files, COUNT(*) AS total_records FROM c",
    "mart_write": f"{C} {mart_sql('mart_temporal')}",
    "mart_read": f"{C} {mart_sql('mart_modalidades')}",
    "run_history_append": f"""{RUNS} SELECT run_id, "timestamp", n AS extract_records,
      n AS inserted_records, CAST(NULL AS BIGINT) AS updated_records, status,
      CAST(anio AS VARCHAR) AS years_affected FROM r""",
    "latest_state": f"""{RUNS} SELECT run_id, "timestamp", n AS extract_records,
      "timestamp" AS watermark, FALSE AS full_load_needed FROM r WHERE status = 'completed'
      ORDER BY "timestamp" DESC, run_id DESC LIMIT 1""",
    # projections and cleaning
    "rename_columns": f"""{LANDED} SELECT id_contrato, fecha_de_firma AS fecha_firma,
      valor_del_contrato AS valor_contrato, localizaci_n AS localizacion,
      modalidad_de_contratacion AS modalidad_contratacion, espostconflicto AS es_postconflicto,
      CAST(NULL AS VARCHAR) AS n_mero_de_cuenta FROM b""",
    "cast_dates": f"""{LANDED} SELECT id_contrato, {_date('fecha_de_firma')} AS fecha_firma,
      {_date('fecha_de_inicio_del_contrato')} AS fecha_inicio,
      {_date('fecha_de_fin_del_contrato')} AS fecha_fin FROM b""",
    "cast_money": f"""{LANDED} SELECT id_contrato, {_money('valor_del_contrato')} AS valor_contrato,
      {_money('valor_pagado')} AS valor_pagado, {_money('valor_facturado')} AS valor_facturado FROM b""",
    "clean_strings": f"""{LANDED} SELECT id_contrato, TRIM(nombre_entidad, {_SPACES}) AS nombre_entidad,
      TRIM(localizaci_n, {_SPACES}) AS localizaci_n,
      TRIM(objeto_del_contrato, {_SPACES}) AS objeto_del_contrato FROM b""",
    "extract_year": f"{LANDED} SELECT id_contrato, COALESCE(YEAR({_date('fecha_de_firma')}), 0) AS anio FROM b",
    "row_hash": f"""{LANDED} SELECT id_contrato, {_hash(['id_contrato', 'nombre_entidad', 'fecha_de_firma',
      'valor_del_contrato', 'valor_pagado', 'saldo_cdp'])} AS row_hash FROM b""",
    "bronze_to_silver": f"{TYPED} SELECT * FROM s",
    "url_unwrap": f"{C} SELECT id_contrato, json_extract_string(url_proceso, '$.url') AS url_proceso FROM c",
    "contract_summary": f"{C} SELECT {SUMMARY} FROM c",
    "contract_detail": f"""{P} SELECT {SUMMARY}, nit_entidad, departamento, ciudad, objeto_contrato,
      fecha_inicio, fecha_fin, valor_pagado, valor_facturado, documento_proveedor, url_proceso,
      tipo_contrato, duracion_contrato, TRY_CAST(dias_adicionados AS INTEGER) AS dias_adicionados,
      localizacion, sector, rama, origen_recursos, destino_gasto, es_postconflicto FROM c""",
    "execution_pct": f"""{P} SELECT id_contrato, {SHARE} AS ejecucion_pct,
      LEAST(COALESCE({SHARE}, 0), 100) AS barra_pct FROM c""",
    "high_value_flag": f"""{C} SELECT id_contrato,
      COALESCE(valor_contrato * 20000 > 5000000000, FALSE) AS valor_alto FROM c""",
    "status_class": f"""{C} SELECT id_contrato, estado_contrato, CASE
      WHEN lower(estado_contrato) LIKE '%ejecución%' OR lower(estado_contrato) LIKE '%activo%' THEN 'success'
      WHEN lower(estado_contrato) LIKE '%suspendido%' THEN 'warning' ELSE 'default' END AS clase FROM c""",
    "supplier_concentration_level": f"""{C}, g AS ({SUPPLIER} GROUP BY documento_proveedor)
      SELECT *, CASE WHEN total_contratos > 100 THEN 'Alto' WHEN total_contratos > 50 THEN 'Medio'
        ELSE 'Bajo' END AS riesgo FROM g""",
    "public_projection": f"""{C} SELECT id_contrato, valor_contrato, fecha_firma,
      sha256('ejemplo-' || documento_proveedor) AS seudonimo FROM c""",
    # filters
    **{name: f"{C} SELECT {SUMMARY} FROM c WHERE {_condition(name)}" for name in FILTERS},
    "search_entities": f"""{C} {ENTITY} AND (nombre_entidad ILIKE '%tion_1%' OR nit_entidad = 'tion_1')
      GROUP BY nit_entidad""",
    "search_suppliers": f"""{C} {SUPPLIER} AND (proveedor_adjudicado ILIKE '%#00000001%'
      OR documento_proveedor = '#00000001') GROUP BY documento_proveedor""",
    "lookup_contract": f"""{P} SELECT {SUMMARY}, nit_entidad, departamento, ciudad, objeto_contrato,
      fecha_inicio, fecha_fin, valor_pagado, valor_facturado, documento_proveedor, url_proceso,
      tipo_contrato, duracion_contrato, TRY_CAST(dias_adicionados AS INTEGER) AS dias_adicionados,
      localizacion, sector, rama, origen_recursos, destino_gasto, es_postconflicto FROM c
      WHERE id_contrato = '42'""",
    "lookup_entity": f"{C} {ENTITY_DETAIL} WHERE nit_entidad = '7' GROUP BY nit_entidad",
    "lookup_supplier": f"{C} {SUPPLIER_COLUMNS} WHERE documento_proveedor = '11' GROUP BY documento_proveedor",
    "watermark_filter": f"""{P} SELECT id_contrato, ultima_actualizacion FROM c
      WHERE ultima_actualizacion >= strftime(CAST('{WATERMARK[:10]}' AS DATE) - 7, '%Y-%m-%dT00:00:00.000')""",
    "years_filter": f"{C} SELECT id_contrato, anio FROM c WHERE YEAR(fecha_firma) IN ({YEAR_LIST})",
    "not_null_guards": f"""{C} SELECT
      {_count_if('nit_entidad IS NOT NULL AND nombre_entidad IS NOT NULL AND fecha_firma IS NOT NULL', 'mart_entidades')},
      {_count_if('documento_proveedor IS NOT NULL AND proveedor_adjudicado IS NOT NULL AND fecha_firma IS NOT NULL', 'mart_proveedores')},
      {_count_if('fecha_firma IS NOT NULL', 'mart_temporal')},
      {_count_if('modalidad_contratacion IS NOT NULL AND fecha_firma IS NOT NULL', 'mart_modalidades')},
      {_count_if('localizacion IS NOT NULL', 'por_localidad')},
      {_count_if('modalidad_contratacion IS NOT NULL', 'modalidades')} FROM c""",
    "row_count_guard": f"""WITH a AS (SELECT COUNT(*) AS anteriores,
        COUNT(*) FILTER (WHERE CAST(o_orderdate AS DATE) <= DATE '{SNAPSHOT}') AS nuevos FROM orders),
      b AS (SELECT *, CAST(FLOOR(CAST(anteriores AS DOUBLE) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS minimo FROM a)
      SELECT *, anteriores = 0 OR nuevos >= minimo AS aceptado FROM b""",
    "silver_validate": f"{C} SELECT anio, COUNT(*) AS registros FROM c GROUP BY anio",
    "mart_validate": C
    + f""", m1 AS ({mart_sql('mart_entidades')}), m2 AS ({mart_sql('mart_proveedores')}),
      m3 AS ({mart_sql('mart_temporal')}), m4 AS ({mart_sql('mart_modalidades')})
      SELECT 'mart_entidades' AS mart, COUNT(*) AS filas,
        {_count_if('total_contratos < 0 OR valor_total < 0', 'fuera_de_rango')} FROM m1
      UNION ALL SELECT 'mart_proveedores', COUNT(*), {_count_if('valor_total < 0', 'x')} FROM m2
      UNION ALL SELECT 'mart_temporal', COUNT(*),
        {_count_if('mes < 1 OR mes > 12 OR total_contratos < 0', 'x')} FROM m3
      UNION ALL SELECT 'mart_modalidades', COUNT(*),
        {_count_if('participacion_pct < 0 OR participacion_pct > 100', 'x')} FROM m4""",
    "quality_report": f"""{C} SELECT COUNT(*) AS registros, CAST(7 AS BIGINT) AS columnas,
      {_count_if('fecha_firma IS NULL', 'fecha_firma_nula')},
      {_count_if('valor_contrato IS NULL', 'valor_contrato_nula')},
      {_count_if('id_contrato IS NULL', 'id_contrato_nula')} FROM c""",
    "cast_failure_report": LANDED
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{silver}' AS columna, COUNT({page}) AS con_texto,
          {_count_if(f'{page} IS NOT NULL AND ({value}) IS NULL', 'sin_convertir')} FROM b"""
        for silver, page, value in LOST
    ),
    "quality_rules": f"""{FEED}, k AS (SELECT COUNT(*) AS n FROM s WHERE id_contrato IS NOT NULL GROUP BY id_contrato)
      SELECT 'nit_entidad_nulo' AS regla, {_count_if('nit_entidad IS NULL', 'violaciones')} FROM s
      UNION ALL SELECT 'id_contrato_nulo', {_count_if('id_contrato IS NULL', 'x')} FROM s
      UNION ALL SELECT 'valor_contrato_no_numerico', {_count_if('valor_contrato IS NULL', 'x')} FROM s
      UNION ALL SELECT 'valor_contrato_negativo', {_count_if('valor_contrato < 0', 'x')} FROM s
      UNION ALL SELECT 'fecha_firma_invalida', {_count_if('fecha_firma IS NULL', 'x')} FROM s
      UNION ALL SELECT 'id_contrato_repetido', {_count_if('n > 1', 'x')} FROM k""",
    # merge
    "merge_inserts": f"{MERGE} {INSERTS}",
    "merge_updates": f"{MERGE} {UPDATES}",
    "merge_unchanged": f"""{MERGE} SELECT {MERGE_COLUMNS} FROM i JOIN e ON e.id_contrato = i.id_contrato
      WHERE e.row_hash = i.row_hash""",
    "merge_silver": f"""{MERGE}, u AS ({UPDATES}), n2 AS ({INSERTS})
      SELECT id_contrato, valor_pagado, fecha_firma, anio, row_hash FROM e
      WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id_contrato = e.id_contrato)
      UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM u""",
    "merge_metrics": f"""{MERGE} SELECT {_count_if('e.id_contrato IS NULL', 'inserted')},
      {_count_if(f'e.row_hash <> i.row_hash AND NOT {OLDER}', 'updated')},
      {_count_if('e.row_hash = i.row_hash', 'unchanged')},
      {_count_if(f'e.row_hash <> i.row_hash AND {OLDER}', 'stale')}
      FROM i LEFT JOIN e ON e.id_contrato = i.id_contrato""",
    "latest_versions": f"""{FEED}, w AS (SELECT id_contrato, ultima_actualizacion, valor_facturado, row_hash,
        ROW_NUMBER() OVER (PARTITION BY id_contrato
          ORDER BY ultima_actualizacion DESC NULLS LAST, row_hash DESC) AS version
        FROM s WHERE id_contrato IS NOT NULL)
      SELECT id_contrato, ultima_actualizacion, valor_facturado, row_hash FROM w WHERE version = 1""",
    "gold_partition_upsert": f"""WITH {contracts("o", SNAPSHOT)}, {contracts("c", None, True)},
      u AS (SELECT * FROM c WHERE ultima_actualizacion >=
        strftime(CAST('{WATERMARK[:10]}' AS DATE) - 7, '%Y-%m-%dT00:00:00.000'))
      SELECT id_contrato, valor_contrato, sector, CAST(NULL AS DOUBLE) AS valor_pagado FROM o
      WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id_contrato = o.id_contrato)
      UNION ALL SELECT id_contrato, valor_contrato, NULL, valor_pagado FROM u""",
    "contractor_stats_join": f"""{C}, cs AS (SELECT proveedor_adjudicado AS p,
        COUNT(*) AS total_contratos_contratista, {mean()} AS valor_promedio_contratista
        FROM c WHERE proveedor_adjudicado IS NOT NULL GROUP BY proveedor_adjudicado)
      SELECT id_contrato, proveedor_adjudicado, total_contratos_contratista, valor_promedio_contratista
      FROM c JOIN cs ON proveedor_adjudicado = p""",
    "year_total_join": f"""{C}, g AS ({MODALITY}), t AS (SELECT anio AS y,
        CAST(SUM(CAST(valor_total AS DECIMAL(28,2))) AS DOUBLE) AS total_anio FROM g GROUP BY anio)
      SELECT g.*, total_anio FROM g JOIN t ON y = g.anio""",
    "union_all": f"{MERGE} {INSERTS} UNION ALL {UPDATES}",
    "union_relaxed": f"""{C} SELECT id_contrato, valor_contrato, sector, CAST(NULL AS VARCHAR) AS ciudad FROM c
      UNION ALL SELECT id_contrato, CAST(anio AS DOUBLE), NULL, ciudad FROM c""",
    "key_difference": f"{MERGE} SELECT DISTINCT id_contrato FROM i WHERE id_contrato NOT IN (SELECT id_contrato FROM e)",
    "key_intersection": f"{MERGE} SELECT DISTINCT id_contrato FROM i WHERE id_contrato IN (SELECT id_contrato FROM e)",
    "full_load": LOADED,
    "incremental_load": LOADED,
    # aggregates
    "kpi": f"""{C} SELECT {N}, {zero()} AS valor_total, COALESCE({mean()}, 0) AS valor_promedio,
      COUNT(DISTINCT proveedor_adjudicado) AS contratistas_unicos,
      COUNT(DISTINCT nombre_entidad) AS entidades_unicas,
      COUNT(DISTINCT localizacion) AS localidades_cubiertas FROM c""",
    "top_contractors": f"""{C} SELECT proveedor_adjudicado AS contratista, {N}, {zero()} AS valor_total,
      COALESCE({mean()}, 0) AS valor_promedio FROM c WHERE proveedor_adjudicado IS NOT NULL
      GROUP BY proveedor_adjudicado ORDER BY valor_total DESC, contratista LIMIT 20""",
    "count_unique_contractors": f"{C} SELECT COUNT(DISTINCT proveedor_adjudicado) AS total_contratistas FROM c",
    "by_locality": f"""{C} SELECT localizacion AS localidad, {N}, {zero()} AS valor_total,
      COUNT(DISTINCT proveedor_adjudicado) AS contratistas_unicos,
      COUNT(DISTINCT nombre_entidad) AS entidades_unicas
      FROM c WHERE localizacion IS NOT NULL GROUP BY localizacion""",
    "count_localities": f"{C} SELECT COUNT(DISTINCT localizacion) AS total_localidades FROM c",
    "modalities": f"""{C} SELECT modalidad_contratacion AS modalidad, {N}, {SUM} FROM c
      WHERE modalidad_contratacion IS NOT NULL GROUP BY modalidad_contratacion""",
    "stats_overview": f"""{P} SELECT {N}, COUNT(DISTINCT nit_entidad) AS total_entidades,
      COUNT(DISTINCT documento_proveedor) AS total_proveedores, {zero()} AS valor_total_contratado,
      {zero('valor_pagado')} AS valor_total_pagado, COALESCE(MIN(YEAR(fecha_firma)), 0) AS anio_desde,
      COALESCE(MAX(YEAR(fecha_firma)), 0) AS anio_hasta,
      MAX(ultima_actualizacion) AS ultima_actualizacion FROM c""",
    "count_contracts": f"{C} SELECT {N} FROM c",
    "count_entities": f"{C} SELECT COUNT(DISTINCT nit_entidad) AS total_entidades FROM c",
    "count_suppliers": f"{C} SELECT COUNT(DISTINCT documento_proveedor) AS total_proveedores FROM c",
    "total_values": f"""{P} SELECT {zero()} AS valor_total_contratado,
      {zero('valor_pagado')} AS valor_total_pagado FROM c""",
    "year_range": f"""{C} SELECT COALESCE(MIN(YEAR(fecha_firma)), 0) AS anio_desde,
      COALESCE(MAX(YEAR(fecha_firma)), 0) AS anio_hasta FROM c WHERE fecha_firma IS NOT NULL""",
    "entity_list": f"{C} {ENTITY} GROUP BY nit_entidad",
    "entity_count": f"""{C} SELECT COUNT(DISTINCT nit_entidad) AS total FROM c
      WHERE nit_entidad IS NOT NULL AND nombre_entidad IS NOT NULL""",
    "entity_detail": f"{C} {ENTITY_DETAIL} WHERE nit_entidad = '3' GROUP BY nit_entidad",
    "supplier_list": f"{C} {SUPPLIER} GROUP BY documento_proveedor",
    "supplier_count": f"""{C} SELECT COUNT(DISTINCT documento_proveedor) AS total FROM c
      WHERE documento_proveedor IS NOT NULL AND proveedor_adjudicado IS NOT NULL""",
    "supplier_detail": f"{C} {SUPPLIER_COLUMNS} WHERE documento_proveedor = '25' GROUP BY documento_proveedor",
    "available_years": f"{C} SELECT DISTINCT YEAR(fecha_firma) AS anio FROM c WHERE fecha_firma IS NOT NULL",
    "contract_count": f"""{C} SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / 50.0) AS BIGINT) AS total_pages
      FROM c WHERE modalidad_contratacion = '5-LOW'""",
    "yearly_totals": f"""{C} SELECT YEAR(fecha_firma) AS anio_firma, COUNT(*) AS cantidad,
      {total()} AS total_contratado FROM c GROUP BY YEAR(fecha_firma)""",
    "yearly_contracted_vs_paid": f"""{P} SELECT YEAR(fecha_firma) AS anio, {zero()} AS contratado,
      {zero('valor_pagado')} AS pagado FROM c WHERE fecha_firma IS NOT NULL GROUP BY YEAR(fecha_firma)""",
    "entity_execution": f"""{P}, g AS ({EXECUTION}) SELECT nit_entidad, nombre_entidad, contratado, pagado,
      {EXECUTION_PCT} AS ejecucion_pct FROM g""",
    "entity_modality_breakdown": f"""{C} SELECT nit_entidad, modalidad_contratacion AS modalidad,
      COUNT(*) AS contratos, {zero()} AS valor FROM c
      WHERE nit_entidad IS NOT NULL AND modalidad_contratacion IS NOT NULL
      GROUP BY nit_entidad, modalidad_contratacion""",
    "entity_top_suppliers": f"""{C}, g AS (SELECT nit_entidad, documento_proveedor,
        MAX(proveedor_adjudicado) AS proveedor, COUNT(*) AS contratos, {zero()} AS valor FROM c
        WHERE nit_entidad IS NOT NULL AND documento_proveedor IS NOT NULL
        GROUP BY nit_entidad, documento_proveedor),
      w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY nit_entidad
        ORDER BY valor DESC, documento_proveedor) AS puesto FROM g)
      SELECT * FROM w WHERE puesto <= 5""",
    "supplier_kpis": f"""{C}, g AS (SELECT COUNT(*) AS n, MAX(es_pyme) AS pyme FROM c
        WHERE documento_proveedor IS NOT NULL GROUP BY documento_proveedor)
      SELECT COUNT(*) AS total_proveedores, CAST(SUM(n) AS DOUBLE) / COUNT(*) AS contratos_promedio,
        {pct("CAST(COUNT(*) FILTER (WHERE pyme = 'Si') AS DOUBLE)", 'COUNT(*)')} AS pyme_pct,
        {pct('CAST(COUNT(*) FILTER (WHERE n > 50) AS DOUBLE)', 'COUNT(*)')} AS concentracion_alta_pct FROM g""",
    "entity_kpis": f"""{P}, g AS ({EXECUTION}), h AS (SELECT *,
        CAST(FLOOR({EXECUTION_PCT} * 1000000 + 0.5) AS BIGINT) AS millionths FROM g)
      SELECT COUNT(*) AS total_entidades, CAST(SUM(n) AS DOUBLE) / COUNT(*) AS contratos_promedio,
        {total('contratado')} / COUNT(*) AS valor_promedio,
        CAST(SUM(millionths) AS DOUBLE) / COUNT(millionths) / CAST(1000000 AS DOUBLE) AS ejecucion_promedio_pct
      FROM h""",
    "unpaid_over_12_months": f"""{P} SELECT id_contrato, fecha_firma, valor_pagado FROM c
      WHERE COALESCE(valor_pagado, 0) = 0 AND fecha_firma < CAST(DATE '{AS_OF}' - INTERVAL 12 MONTH AS DATE)""",
    "new_watermark": f"{P} SELECT GREATEST(MAX(ultima_actualizacion), '{WATERMARK}') AS watermark FROM c",
    "affected_years": f"""{MERGE}, x AS (SELECT i.anio, e.anio AS anio_previo FROM i
        LEFT JOIN e ON e.id_contrato = i.id_contrato
        WHERE e.id_contrato IS NULL OR e.row_hash <> i.row_hash)
      SELECT anio FROM x UNION SELECT anio_previo FROM x WHERE anio_previo IS NOT NULL""",
    # marts
    **{name: f"{C} {mart_sql(name)}" for name in MARTS},
    **{f"{name}_incremental": mart_incremental(name) for name in MARTS},
    **{f"{name}_difference": f"{C} {mart_sql(name)}" for name in MARTS},
    "participation_pct": f"{C} {mart_sql('mart_modalidades')}",
    "build_marts": C
    + " "
    + " UNION ALL ".join(f"SELECT '{m}' AS mart, COUNT(*) AS filas FROM ({mart_sql(m)})" for m in MARTS),
    # The place of a row in the file of its year.
    "mart_sort": f"""{C}, m AS ({mart_sql('mart_proveedores')})
      SELECT *, ROW_NUMBER() OVER (PARTITION BY anio ORDER BY documento_proveedor) - 1 AS posicion FROM m""",
    # pages and lists
    "contracts_page": f"{C} SELECT {SUMMARY} FROM c {NEWEST} LIMIT 50 OFFSET 100",
    "contracts_page_filtered": f"""{C} SELECT {SUMMARY} FROM c WHERE (nombre_entidad ILIKE '%tion_1%' OR nit_entidad = 'tion_1')
      AND valor_contrato >= 1000 {NEWEST} LIMIT 50 OFFSET 50""",
    "contracts_page_after": f"""{C} SELECT {SUMMARY} FROM c WHERE fecha_firma < DATE '2000-05-05'
      OR (fecha_firma = DATE '2000-05-05' AND id_contrato > '5') OR fecha_firma IS NULL {NEWEST} LIMIT 50""",
    "entity_page": f"""{C} {ENTITY} GROUP BY nit_entidad
      ORDER BY valor_total DESC NULLS LAST, nit_entidad LIMIT 10 OFFSET 10""",
    "supplier_page": f"""{C} {SUPPLIER} GROUP BY documento_proveedor
      ORDER BY valor_total DESC NULLS LAST, documento_proveedor LIMIT 25 OFFSET 25""",
    "entity_recent_contracts": f"{C} SELECT {SUMMARY} FROM c WHERE nit_entidad = '4' {NEWEST} LIMIT 10",
    "supplier_recent_contracts": f"{C} SELECT {SUMMARY} FROM c WHERE documento_proveedor = '17' {NEWEST} LIMIT 10",
    "recent_contracts_all": _ranked("nit_entidad"),
    "recent_contracts_all_suppliers": _ranked("documento_proveedor"),
    # risk
    "risk_contracts": f"{flagged(**RISK)} {RISK_ROWS}",
    "risk_contracts_default": f"{flagged(10, 5)} {RISK_ROWS}",
    "risk_indicators": f"{flagged(**RISK)} SELECT id_contrato, {INDICATORS} AS indicadores FROM g",
    "risk_level": f"""{flagged(**RISK)} SELECT {LEVEL} AS nivel_riesgo, COUNT(*) AS contratos
      FROM g GROUP BY 1""",
    "risk_summary": f"{flagged(**RISK)} SELECT COUNT(*) AS total_analizados FROM g",
    "risk_type": f"""{flagged(**RISK)} SELECT id_contrato, proveedor_adjudicado AS proveedor,
        valor_contrato, n AS contratos_proveedor, 'concentracion' AS tipo_riesgo,
        {MANY_TEXT} AS descripcion FROM g WHERE many
      UNION ALL SELECT id_contrato, proveedor_adjudicado, valor_contrato, n, 'valor_atipico', {ODD_TEXT}
      FROM g WHERE valor_contrato > m * {RISK['times']}""",
}
