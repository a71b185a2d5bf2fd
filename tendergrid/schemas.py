"""Names and types of the contract tables.

The column lists below are fixed values: landing pages and existing Parquet
tables already carry these names, so they cannot be chosen freely.
"""

from pyspark.sql import types as T

KEY = "id_contrato"
YEAR = "anio"
ROW_HASH = "row_hash"
UPDATED_AT = "ultima_actualizacion"
UNKNOWN_YEAR = 0

# Fixed values: (typed-table column, landing-page column, kind), in table order.
SILVER_COLUMNS = [
    ("id_contrato", "id_contrato", "text"),
    ("nombre_entidad", "nombre_entidad", "text"),
    ("nit_entidad", "nit_entidad", "text"),
    ("codigo_entidad", "codigo_entidad", "text"),
    ("departamento", "departamento", "text"),
    ("ciudad", "ciudad", "text"),
    ("orden", "orden", "text"),
    ("sector", "sector", "text"),
    ("rama", "rama", "text"),
    ("proceso_de_compra", "proceso_de_compra", "text"),
    ("referencia_del_contrato", "referencia_del_contrato", "text"),
    ("estado_contrato", "estado_contrato", "text"),
    ("documento_proveedor", "documento_proveedor", "text"),
    ("codigo_proveedor", "codigo_proveedor", "text"),
    ("destino_gasto", "destino_gasto", "text"),
    ("recursos_propios", "recursos_propios", "text"),
    ("nombre_del_banco", "nombre_del_banco", "text"),
    ("tipo_de_cuenta", "tipo_de_cuenta", "text"),
    ("nombre_supervisor", "nombre_supervisor", "text"),
    ("localizacion", "localizaci_n", "text"),
    ("entidad_centralizada", "entidad_centralizada", "text"),
    ("modalidad_contratacion", "modalidad_de_contratacion", "text"),
    ("tipo_contrato", "tipo_de_contrato", "text"),
    ("codigo_categoria_principal", "codigo_de_categoria_principal", "text"),
    ("descripcion_proceso", "descripcion_del_proceso", "text"),
    ("objeto_contrato", "objeto_del_contrato", "text"),
    ("fecha_firma", "fecha_de_firma", "date"),
    ("fecha_inicio", "fecha_de_inicio_del_contrato", "date"),
    ("fecha_fin", "fecha_de_fin_del_contrato", "date"),
    ("duracion_contrato", "duraci_n_del_contrato", "text"),
    ("dias_adicionados", "dias_adicionados", "text"),
    ("proveedor_adjudicado", "proveedor_adjudicado", "text"),
    ("tipo_doc_proveedor", "tipodocproveedor", "text"),
    ("es_grupo", "es_grupo", "text"),
    ("es_pyme", "es_pyme", "text"),
    ("valor_contrato", "valor_del_contrato", "money"),
    ("valor_facturado", "valor_facturado", "money"),
    ("valor_pagado", "valor_pagado", "money"),
    ("valor_pendiente_pago", "valor_pendiente_de_pago", "money"),
    ("valor_pendiente_ejecucion", "valor_pendiente_de_ejecucion", "money"),
    ("saldo_cdp", "saldo_cdp", "money"),
    ("valor_pago_adelantado", "valor_de_pago_adelantado", "money"),
    ("valor_amortizado", "valor_amortizado", "money"),
    ("valor_pendiente_obligacion", "valor_pendiente_de", "money"),
    ("saldo_vigencia", "saldo_vigencia", "money"),
    ("justificacion_modalidad", "justificacion_modalidad_de", "text"),
    ("condiciones_entrega", "condiciones_de_entrega", "text"),
    ("habilita_pago_adelantado", "habilita_pago_adelantado", "text"),
    ("liquidacion", "liquidaci_n", "text"),
    ("obligacion_ambiental", "obligaci_n_ambiental", "text"),
    ("obligaciones_postconsumo", "obligaciones_postconsumo", "text"),
    ("reversion", "reversion", "text"),
    ("contrato_prorrogable", "el_contrato_puede_ser_prorrogado", "text"),
    ("origen_recursos", "origen_de_los_recursos", "text"),
    ("presupuesto_pgn", "presupuesto_general_de_la_nacion_pgn", "text"),
    ("sgp", "sistema_general_de_participaciones", "text"),
    ("sgr", "sistema_general_de_regal_as", "text"),
    (
        "recursos_propios_territoriales",
        "recursos_propios_alcald_as_gobernaciones_y_resguardos_ind_genas_",
        "text",
    ),
    ("recursos_credito", "recursos_de_credito", "text"),
    ("nombre_representante_legal", "nombre_representante_legal", "text"),
    ("nacionalidad_representante_legal", "nacionalidad_representante_legal", "text"),
    ("domicilio_representante_legal", "domicilio_representante_legal", "text"),
    ("tipo_id_representante_legal", "tipo_de_identificaci_n_representante_legal", "text"),
    ("genero_representante_legal", "g_nero_representante_legal", "text"),
    ("nombre_ordenador_gasto", "nombre_ordenador_del_gasto", "text"),
    ("tipo_doc_ordenador_gasto", "tipo_de_documento_ordenador_del_gasto", "text"),
    ("tipo_doc_supervisor", "tipo_de_documento_supervisor", "text"),
    ("nombre_ordenador_pago", "nombre_ordenador_de_pago", "text"),
    ("tipo_doc_ordenador_pago", "tipo_de_documento_ordenador_de_pago", "text"),
    ("num_doc_ordenador_pago", "n_mero_de_documento_ordenador_de_pago", "text"),
    ("url_proceso", "urlproceso", "url"),
    ("documentos_tipo", "documentos_tipo", "text"),
    ("descripcion_documentos_tipo", "descripcion_documentos_tipo", "text"),
    ("es_postconflicto", "espostconflicto", "text"),
    ("puntos_acuerdo", "puntos_del_acuerdo", "text"),
    ("pilares_acuerdo", "pilares_del_acuerdo", "text"),
]

# Landing-page columns that the typed table does not keep.
UNTYPED_PAGE_COLUMNS = [
    "identificaci_n_representante_legal",
    "n_mero_de_cuenta",
    "n_mero_de_documento_ordenador_del_gasto",
    "n_mero_de_documento_supervisor",
    "fecha_inicio_liquidacion",
    "fecha_fin_liquidacion",
    "fecha_de_notificaci_n_de_prorrogaci_n",
]

# Columns that must not reach a public output, under both of
# the names they can have.
SENSITIVE_COLUMNS = [
    "documento_proveedor",
    "identificaci_n_representante_legal",
    "n_mero_de_documento_supervisor",
    "n_mero_de_documento_ordenador_del_gasto",
    "n_mero_de_cuenta",
]

# Columns of a search result and of a single contract.
SUMMARY_COLUMNS = [
    "id_contrato",
    "nombre_entidad",
    "proveedor_adjudicado",
    "valor_contrato",
    "fecha_firma",
    "estado_contrato",
    "modalidad_contratacion",
]
DETAIL_COLUMNS = SUMMARY_COLUMNS + [
    "nit_entidad",
    "departamento",
    "ciudad",
    "objeto_contrato",
    "fecha_inicio",
    "fecha_fin",
    "valor_pagado",
    "valor_facturado",
    "documento_proveedor",
    "url_proceso",
    "tipo_contrato",
    "duracion_contrato",
    "dias_adicionados",
    "localizacion",
    "sector",
    "rama",
    "origen_recursos",
    "destino_gasto",
    "es_postconflicto",
]

PAGE_TO_SILVER = {page: silver for silver, page, _ in SILVER_COLUMNS if page != silver}
DATE_COLUMNS = [silver for silver, _, kind in SILVER_COLUMNS if kind == "date"]
MONEY_COLUMNS = [silver for silver, _, kind in SILVER_COLUMNS if kind == "money"]
PAGE_BUSINESS_COLUMNS = [page for _, page, _ in SILVER_COLUMNS]

BRONZE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in PAGE_BUSINESS_COLUMNS + [UPDATED_AT] + UNTYPED_PAGE_COLUMNS
    ]
)

_TYPE_OF_KIND = {
    "text": T.StringType(),
    "url": T.StringType(),
    "date": T.DateType(),
    "money": T.DoubleType(),
}

SILVER_SCHEMA = T.StructType(
    [T.StructField(silver, _TYPE_OF_KIND[kind]) for silver, _, kind in SILVER_COLUMNS]
    + [
        T.StructField(UPDATED_AT, T.StringType()),
        T.StructField(YEAR, T.IntegerType()),
        T.StructField(ROW_HASH, T.StringType()),
    ]
)

RUN_HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("extract_records", T.LongType()),
        T.StructField("inserted_records", T.LongType()),
        T.StructField("updated_records", T.LongType()),
        T.StructField("unchanged_records", T.LongType()),
        T.StructField("stale_records", T.LongType()),
        T.StructField("rejected_records", T.LongType()),
        T.StructField("years_affected", T.ArrayType(T.IntegerType())),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("watermark", T.StringType()),
        T.StructField("silver_records", T.LongType()),
        T.StructField("gold_records", T.LongType()),
        T.StructField("missing_values", T.MapType(T.StringType(), T.LongType())),
        T.StructField("failed_casts", T.MapType(T.StringType(), T.LongType())),
    ]
)
