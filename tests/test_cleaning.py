import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendergrid.functions import cleaning, derived
from tendergrid.operators import transform
from tendergrid.schemas import BRONZE_SCHEMA, SILVER_COLUMNS, SILVER_SCHEMA


def one(spark, value, expression, kind="string"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, day",
    [
        ("2023-01-15T00:00:00.000", dt.date(2023, 1, 15)),
        ("2023-12-31", dt.date(2023, 12, 31)),
        ("mañana", None),
        ("2023-1-5", None),
        ("2023", None),
        ("2023-02-30", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    assert one(spark, text, cleaning.iso_date) == day


@pytest.mark.parametrize(
    "text, amount",
    [
        ("1000.00", 1000.0),
        ("-812.40", -812.4),
        ("$ 1,500.50 COP", 1500.5),
        ("N/A", None),
        ("1.234.567,89", None),
        ("--5", None),
        ("", None),
        (None, None),
    ],
)
def test_money(spark, text, amount):
    assert one(spark, text, cleaning.money) == amount


@pytest.mark.parametrize("text", ["  IDU ", "\tIDU\n", " IDU　", "\x85IDU ", "IDU"])
def test_strip(spark, text):
    assert one(spark, text, cleaning.strip_text) == "IDU"


@pytest.mark.parametrize(
    "text, url",
    [('{"url": "https://e.org/?a=1"}', "https://e.org/?a=1"), ("https://e.org", "https://e.org"), (None, None)],
)
def test_url(spark, text, url):
    assert one(spark, text, cleaning.unwrap_url) == url


def test_rename_keeps_unknown_columns(spark):
    rows = spark.createDataFrame([("1", "x", "2023-01-01")], "id_contrato string, otro string, fecha_de_firma string")
    assert transform.rename_columns(rows).columns == ["id_contrato", "otro", "fecha_firma"]


def test_year_of_missing_date_or_column_is_zero(spark):
    rows = spark.createDataFrame([(dt.date(2023, 1, 1),), (None,)], "fecha_firma date")
    assert [r["anio"] for r in transform.extract_year(rows).collect()] == [2023, 0]
    bare = transform.extract_year(spark.createDataFrame([(1,)], "id int"))
    assert bare.first()["anio"] == 0 and bare.schema["anio"].dataType == T.IntegerType()


def test_clean_strings_leaves_other_types(spark):
    rows = transform.clean_strings(spark.createDataFrame([(1, " a ")], "id int, n string"))
    assert rows.first().asDict() == {"id": 1, "n": "a"}


def test_hash_sees_every_amount_but_not_the_update_time(spark):
    base = {f.name: None for f in BRONZE_SCHEMA} | {"id_contrato": "1", "valor_pagado": "5"}
    variants = [
        base,
        base | {"ultima_actualizacion": "2024-01-01"},
        base | {"valor_pagado": "6"},
        base | {"saldo_vigencia": "6"},
        base | {"valor_pagado": None, "valor_amortizado": "5"},
    ]
    rows = spark.createDataFrame([tuple(v[f.name] for f in BRONZE_SCHEMA) for v in variants], BRONZE_SCHEMA)
    hashes = [r["row_hash"] for r in transform.bronze_to_silver(rows).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 4


def test_silver_schema(spark):
    silver = transform.bronze_to_silver(spark.createDataFrame([], BRONZE_SCHEMA))
    assert [(f.name, f.dataType) for f in silver.schema] == [(f.name, f.dataType) for f in SILVER_SCHEMA]
    assert len(SILVER_COLUMNS) == 76


def test_absent_page_columns_become_null(spark):
    rows = spark.createDataFrame([("1",)], "id_contrato string")
    assert transform.bronze_to_silver(rows).first()["valor_contrato"] is None


@pytest.mark.parametrize(
    "paid, value, pct, bar",
    [(50.0, 200.0, 25, 25), (1.0, 8.0, 13, 13), (300.0, 200.0, 150, 100), (0.0, 5.0, None, 0), (None, 5.0, None, 0), (5.0, 0.0, None, 0)],
)
def test_execution(spark, paid, value, pct, bar):
    row = spark.createDataFrame([(paid, value)], "p double, v double").select(
        derived.execution_pct(F.col("p"), F.col("v")), derived.execution_bar(F.col("p"), F.col("v"))
    ).first()
    assert tuple(row) == (pct, bar)


@pytest.mark.parametrize(
    "status, cls", [("En ejecución", "success"), ("ACTIVO", "success"), ("Suspendido", "warning"), ("Cerrado", "default"), (None, "default")]
)
def test_status(spark, status, cls):
    assert one(spark, status, derived.status_class) == cls


@pytest.mark.parametrize("n, level", [(50, "Bajo"), (51, "Medio"), (100, "Medio"), (101, "Alto")])
def test_concentration(spark, n, level):
    assert one(spark, n, derived.concentration_level, "bigint") == level


def test_high_value(spark):
    values = [one(spark, v, derived.is_high_value, "double") for v in (5e9, 5e9 + 1, None)]
    assert values == [False, True, False]


def test_public_projection(spark):
    rows = spark.createDataFrame([("1", "doc")], "id_contrato string, documento_proveedor string")
    assert transform.public_projection(rows).columns == ["id_contrato"]
    assert len(transform.public_projection(rows, "salt").first()["documento_proveedor"]) == 64


def test_only_texts_with_odd_ends_are_trimmed(spark):
    texts = ["", "a", " a", "a　", "\xa0é b\t", "é", "bé", "a b", "\x85", " x", "~!", "x\x7f", None, "\U0001f600 "]
    rows = spark.createDataFrame([(text,) for text in texts], "t string")
    got = [row[0] for row in rows.select(cleaning.strip_text(F.col("t"))).collect()]
    assert got == [text if text is None else text.strip(cleaning.WHITESPACE) for text in texts]
    assert "ascii" in str(cleaning.strip_text(F.col("t")))


def test_the_hash_takes_missing_values_as_empty_texts(spark):
    rows = spark.createDataFrame([("a", None, 3), (None, None, None), ("", "|", 0)], "a string, b string, c int")
    got = [row[0] for row in rows.select(cleaning.text_hash(["a", "b", "c"])).collect()]
    assert got == [hashlib.sha256(text.encode()).hexdigest() for text in ("a||3", "||", "|||0")]
