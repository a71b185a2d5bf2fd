import random

import pytest
from pyspark.sql import functions as F

from tendergrid.operators import merge, quality

SCHEMA = "id_contrato string, row_hash string, anio int, ultima_actualizacion string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_each_case(spark):
    old = frame(spark, [("same", "h1", 2023, "1"), ("changed", "h1", 2023, "1"), ("moved", "h1", 2023, "1"), ("kept", "h9", 2020, "1")])
    new = frame(spark, [
        ("same", "h1", 2023, "5"), ("changed", "h2", 2023, "5"), ("moved", "h3", 2024, "5"),
        ("new", "h1", 2021, "5"), ("twice", "old", 2022, "3"), ("twice", "new", 2022, "4"), (None, "h", 2019, "9"),
    ])
    changes = merge.classify(old, merge.latest_versions(new))
    assert merge.merge_metrics(changes).first().asDict() == {"inserted": 2, "updated": 2, "unchanged": 1, "stale": 0}
    assert {r[0] for r in merge.affected_years(changes).collect()} == {2021, 2022, 2023, 2024}
    assert merge.rejected_count(new).first()[0] == 1
    merged = {r["id_contrato"]: (r["row_hash"], r["anio"]) for r in merge.merge_silver(old, new).collect()}
    assert merged == {
        "same": ("h1", 2023), "changed": ("h2", 2023), "moved": ("h3", 2024),
        "kept": ("h9", 2020), "new": ("h1", 2021), "twice": ("new", 2022),
    }
    assert merge.new_watermark(new, "7").first()[0] == "9"
    assert merge.new_watermark(new.where("false"), "7").first()[0] == "7"


def test_tie_takes_the_greatest_hash(spark):
    rows = frame(spark, [("a", "h1", 1, "5"), ("a", "h2", 1, "5"), ("a", "h9", 1, "4"), ("a", "h8", 1, None)])
    assert [r["row_hash"] for r in merge.latest_versions(rows).collect()] == ["h2"]


def test_empty_table_takes_everything(spark):
    new = frame(spark, [("a", "h", 1, "1"), ("b", "h", 1, "1")])
    changes = merge.classify(new.where("false"), merge.latest_versions(new))
    assert merge.merge_metrics(changes).first().asDict() == {"inserted": 2, "updated": 0, "unchanged": 0, "stale": 0}
    assert merge.merge_silver(new.where("false"), new).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_random_batches_against_dictionaries(spark, seed):
    pick = random.Random(seed)
    old = {f"k{i}": (f"h{pick.randrange(3)}", pick.randrange(2020, 2024)) for i in pick.sample(range(60), 30)}
    batch = [
        (f"k{pick.choice([7, pick.randrange(60)])}", f"h{pick.randrange(3)}", pick.randrange(2020, 2024), str(pick.randrange(5)))
        for _ in range(80)
    ]
    latest = {}
    for key, digest, year, stamp in batch:
        if key not in latest or (stamp, digest) > latest[key][:2]:
            latest[key] = (stamp, digest, year)
    # Rows that tie in time and hash are copies of each other in real data, so give them one year.
    years = {(k, s, d): y for k, (s, d, y) in latest.items()}
    batch = [(k, d, years.get((k, s, d), y), s) for k, d, y, s in batch]
    existing = frame(spark, [(k, d, y, "0") for k, (d, y) in old.items()])
    incoming = frame(spark, batch)
    expected = dict(old) | {
        k: (d, y) for k, (s, d, y) in latest.items() if k not in old or old[k][0] != d
    }
    merged = merge.merge_silver(existing, incoming)
    rows = merged.collect()
    assert {r["id_contrato"]: (r["row_hash"], r["anio"]) for r in rows} == expected
    assert len(rows) == len(expected)
    again = merge.classify(merged, merge.latest_versions(incoming))
    assert merge.merge_metrics(again).first().asDict() == {"inserted": 0, "updated": 0, "unchanged": len(latest), "stale": 0}
    parts = [f(existing, incoming).count() for f in (merge.merge_inserts, merge.merge_updates, merge.merge_unchanged)]
    assert sum(parts) == len(latest)
    for keys in (None, incoming.select("id_contrato").where("id_contrato IS NOT NULL")):
        changes = merge.classify(existing, merge.latest_versions(incoming), keys)
        counts = merge.merge_metrics(changes).first()
        assert [counts["inserted"], counts["updated"], counts["unchanged"]] == parts


def test_null_keys_do_not_empty_the_result(spark):
    left = frame(spark, [("a", "h", 1, "1"), ("b", "h", 1, "1")])
    right = frame(spark, [("a", "h", 1, "1"), (None, "h", 1, "1")])
    assert [r[0] for r in merge.key_difference(left, right).collect()] == ["b"]
    assert [r[0] for r in merge.key_intersection(left, right).collect()] == ["a"]


def test_union_relaxed_widens(spark):
    a = spark.createDataFrame([(1, "x")], "n int, a string")
    b = spark.createDataFrame([(2.5, "y")], "n double, b string")
    assert {tuple(r) for r in merge.union_relaxed(a, b).collect()} == {(1.0, "x", None), (2.5, None, "y")}


def test_row_count_guard(spark):
    quality.check_row_count(0, 0)
    quality.check_row_count(10, 9)
    with pytest.raises(quality.DataQualityError):
        quality.check_row_count(10, 8)
    ten, eight = spark.range(10), spark.range(8)
    assert quality.row_count_guard(ten, eight).first().asDict() == {
        "anteriores": 10, "nuevos": 8, "minimo": 9, "aceptado": False,
    }


def test_quality_rules(spark):
    rows = spark.createDataFrame(
        [("a", "1", 5.0, None), ("a", None, -1.0, None), (None, "1", None, None)],
        "id_contrato string, nit_entidad string, valor_contrato double, fecha_firma date",
    )
    found = {r["regla"]: r["violaciones"] for r in quality.quality_rules(rows).collect()}
    assert found == {
        "nit_entidad_nulo": 1, "id_contrato_nulo": 1, "valor_contrato_no_numerico": 1,
        "valor_contrato_negativo": 1, "fecha_firma_invalida": 3, "id_contrato_repetido": 1,
    }
    assert quality.quality_report(rows).first()["id_contrato_nula"] == 1


def test_cast_failures(spark):
    rows = spark.createDataFrame([("x", "5"), (None, "N/A"), ("2023-01-01", None)], "fecha_de_firma string, valor_pagado string")
    found = {r["columna"]: (r["con_texto"], r["sin_convertir"]) for r in quality.cast_failure_report(rows).collect()}
    assert found == {"fecha_firma": (2, 1), "valor_pagado": (2, 1)}


def test_older_rows_do_not_win(spark):
    old = frame(spark, [("a", "h1", 2024, "2024-09-01"), ("b", "h1", 2024, None)])
    new = frame(spark, [("a", "h2", 2023, "2024-01-01"), ("b", "h2", 2023, "2020-01-01")])
    assert merge.merge_metrics(merge.classify(old, new)).first().asDict() == {"inserted": 0, "updated": 1, "unchanged": 0, "stale": 1}
    assert [r["id_contrato"] for r in merge.merge_updates(old, new).collect()] == ["b"]
    assert {(r["id_contrato"], r["row_hash"]) for r in merge.merge_silver(old, new).collect()} == {("a", "h1"), ("b", "h2")}
