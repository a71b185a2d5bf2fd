import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import PAGE_1, PAGE_2, write_page
from tendergrid.functions import money
from tendergrid.operators import quality
from tendergrid.plans import loads, marts
from tendergrid.plans.loads import Lake
from tendergrid.sources import lake, order_tables, pages, run_log, versions
from tendergrid.streaming.page_feed import follow_pages

FIELDS = ["id_contrato", "anio", "valor_contrato", "valor_pagado", "nombre_entidad", "row_hash"]


def content(spark, target, table="gold"):
    return sorted(tuple(r) for r in target.scan(spark, table).select(*FIELDS).collect())


def mart_content(spark, target):
    found = {}
    for mart in marts.MARTS:
        rows = target.scan(spark, mart.name)
        found[mart.name] = sorted(map(str, rows.select(*sorted(rows.columns)).collect()))
    return found


def test_full_load(spark, landing, tmp_path):
    target = Lake(str(tmp_path / "lake"))
    summary = loads.load(spark, str(landing), target)
    assert summary["years"] == {2021: 1, 2022: 2} and summary["extract_records"] == 3
    assert summary["watermark"] == "2023-03-08T00:00:00.000"
    assert summary["marts"] == {"mart_entidades": 3, "mart_proveedores": 3, "mart_temporal": 3, "mart_modalidades": 3}
    rows = {r["id_contrato"]: r for r in target.scan(spark, "gold").collect()}
    assert rows["PX-17/A"]["valor_contrato"] == 4310.25 and rows["QZ-3"]["valor_contrato"] == 12000.5
    assert rows["PX-18"]["nombre_entidad"] == "Archivo Ñuble"
    assert rows["PX-17/A"]["url_proceso"] == "https://example.org/px17"
    assert rows["PX-17/A"]["fecha_firma"] == dt.date(2021, 9, 30)


def test_missing_pages(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        loads.load(spark, str(tmp_path / "none"), Lake(str(tmp_path / "lake")))


def next_batch(folder):
    moved = PAGE_1[0] | {"fecha_de_firma": "2020-05-05T00:00:00.000", "ultima_actualizacion": "2023-04-01T00:00:00.000"}
    paid = PAGE_2[0] | {"valor_pagado": "12.50", "ultima_actualizacion": "2023-04-02T00:00:00.000"}
    older = paid | {"valor_pagado": "3.00", "ultima_actualizacion": "2023-03-30T00:00:00.000"}
    fresh = PAGE_2[0] | {"id_contrato": "QZ-4", "ultima_actualizacion": "2023-04-03T00:00:00.000"}
    unchanged = PAGE_1[1] | {"ultima_actualizacion": "2023-04-09T00:00:00.000"}
    folder.mkdir()
    write_page(folder, 1, [moved, paid, older])
    write_page(folder, 2, [fresh, unchanged, {"nombre_entidad": "sin llave"}])
    return folder


def test_batch(spark, landing, tmp_path):
    target = Lake(str(tmp_path / "lake"))
    loads.load(spark, str(landing), target)
    folder = next_batch(tmp_path / "next")
    summary = loads.load(spark, str(folder), target)
    assert [summary[k] for k in ("inserted_records", "updated_records", "unchanged_records", "rejected_records")] == [1, 2, 1, 1]
    assert summary["years_affected"] == [2020, 2021, 2022] and summary["silver_records"] == 4
    assert summary["watermark"] == "2023-04-09T00:00:00.000"
    gold = {r[0]: r[1:] for r in content(spark, target)}
    assert {k: v[0] for k, v in gold.items()} == {"PX-17/A": 2020, "PX-18": 2022, "QZ-3": 2022, "QZ-4": 2022}
    assert gold["QZ-3"][2] == 12.5
    assert sorted(lake.year_counts(spark, target.root)) == [2020, 2022]
    assert content(spark, target, "silver") == content(spark, target)
    for mart in marts.MARTS:
        full = mart.build(target.scan(spark, "gold"))
        stored = target.scan(spark, mart.name).select(*full.columns)
        assert stored.exceptAll(full).isEmpty() and full.exceptAll(stored).isEmpty()

    kept = target.scan(spark, "rejected").collect()
    assert [(r["nombre_entidad"], r["motivo"]) for r in kept] == [("sin llave", "id_contrato nulo")]

    before = content(spark, target), mart_content(spark, target)
    again = loads.load(spark, str(folder), target)
    assert (again["inserted_records"], again["updated_records"], again["years_affected"]) == (0, 0, [])
    assert (content(spark, target), mart_content(spark, target)) == before


def test_a_growing_folder_is_read_from_the_watermark_on(spark, landing, tmp_path):
    target = Lake(str(tmp_path / "lake"))
    loads.load(spark, str(landing), target)
    late = PAGE_2[0] | {"id_contrato": "QZ-7", "ultima_actualizacion": "2023-03-05T00:00:00.000"}
    undated = {k: v for k, v in PAGE_2[0].items() if k != "ultima_actualizacion"} | {"id_contrato": "QZ-8"}
    write_page(landing, 3, [late, undated])
    summary = loads.load(spark, str(landing), target)
    # The two contracts of the first page lie before the lookback.
    assert (summary["extract_records"], summary["inserted_records"], summary["unchanged_records"]) == (3, 2, 1)


# Each dies when it has done its work, the commit before it begins.
STEPS = [
    (lake, "put_silver"), (quality, "check_amounts"), (lake, "put_gold"), (loads, "put_marts"), (marts, "put_mart"),
    (loads, "_put_rejected"), (versions.Publication, "_measured"), (versions.Publication, "commit"),
]


def test_a_load_killed_at_any_step_changes_nothing(spark, landing, tmp_path, monkeypatch):
    target, twin = Lake(str(tmp_path / "lake")), Lake(str(tmp_path / "twin"))
    for each in (target, twin):
        loads.load(spark, str(landing), each)
    folder = next_batch(tmp_path / "next")
    loads.load(spark, str(folder), twin)
    before = content(spark, target), content(spark, target, "silver"), mart_content(spark, target)

    def dying(step):
        def run(*given, **named):
            if step.__name__ != "commit":
                step(*given, **named)
            raise RuntimeError("driver lost")

        return run

    for owner, name in STEPS:
        with monkeypatch.context() as patch:
            patch.setattr(owner, name, dying(getattr(owner, name)))
            with pytest.raises(RuntimeError, match="driver lost"):
                loads.load(spark, str(folder), target)
        assert (content(spark, target), content(spark, target, "silver"), mart_content(spark, target)) == before, name
        assert target.scan(spark, "rejected") is None
    loads.load(spark, str(folder), target)
    assert content(spark, target) == content(spark, twin) and mart_content(spark, target) == mart_content(spark, twin)
    assert target.scan(spark, "rejected").count() == 1
    statuses = [r["status"] for r in run_log.run_history(spark, target.runs).collect()]
    assert statuses.count("completed") == 2 and statuses.count("failed") == len(STEPS)


def test_a_load_lost_after_its_rename_is_repeated_without_effect(spark, landing, tmp_path, monkeypatch):
    target = Lake(str(tmp_path / "lake"))
    loads.load(spark, str(landing), target)
    folder = next_batch(tmp_path / "next")
    with monkeypatch.context() as patch:
        patch.setattr(versions, "expire", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            loads.load(spark, str(folder), target)
    after = content(spark, target), mart_content(spark, target)
    assert len(after[0]) == 4
    again = loads.load(spark, str(folder), target)
    assert (again["inserted_records"], again["updated_records"]) == (0, 0)
    assert (content(spark, target), mart_content(spark, target)) == after


def test_an_unfit_amount_stops_a_load_before_anything_is_replaced(spark, landing, tmp_path):
    target = Lake(str(tmp_path / "lake"))
    loads.load(spark, str(landing), target)
    before = content(spark, target), content(spark, target, "silver"), mart_content(spark, target)
    folder = tmp_path / "huge"
    folder.mkdir()
    write_page(folder, 1, [PAGE_2[0] | {"id_contrato": "QZ-5", "valor_pagado": "1" + "0" * 27, "ultima_actualizacion": "2023-05-01T00:00:00.000"}])
    for start in (loads.load_batch, loads.load_full):
        with pytest.raises(quality.DataQualityError, match="1 amounts"):
            start(spark, pages.bronze_scan(spark, str(folder)), target)
        assert (content(spark, target), content(spark, target, "silver"), mart_content(spark, target)) == before


def test_the_profile_of_a_load_is_kept_with_its_run(spark, landing, tmp_path):
    target = Lake(str(tmp_path / "lake"))
    loads.load(spark, str(landing), target)
    loads.load(spark, str(next_batch(tmp_path / "next")), target)
    runs = sorted(run_log.run_history(spark, target.runs).collect(), key=lambda r: r["timestamp"])
    report = quality.quality_report(target.scan(spark, "silver")).first().asDict()
    figures = dict(runs[-1]["missing_values"])
    assert figures == {k: v for k, v in report.items() if k.endswith("_nula")}
    full = quality.cast_failure_report(pages.bronze_scan(spark, str(landing))).collect()
    assert dict(runs[0]["failed_casts"] or {}) == {r["columna"]: r["sin_convertir"] for r in full if r["sin_convertir"]}


def test_batch_of_a_later_snapshot_equals_a_full_load(spark, tables, tmp_path):
    day = dt.date(1998, 6, 30)
    target, twin = Lake(str(tmp_path / "lake")), Lake(str(tmp_path / "twin"))
    loads.load_full(spark, order_tables.page_rows(spark, tables, day), target)
    mark = "1998-07-01T00:00:00.000"
    loads.load_batch(spark, order_tables.page_rows(spark, tables), target, since=mark)
    loads.load_full(spark, order_tables.page_rows(spark, tables), twin)
    assert content(spark, target) == content(spark, twin)
    assert mart_content(spark, target) == mart_content(spark, twin)


def test_mart_checks(spark):
    bad = spark.createDataFrame([(13, 1), (2, 1)], "mes int, total_contratos bigint")
    with pytest.raises(quality.DataQualityError):
        quality.mart_validate("mart_temporal", bad)
    assert quality.mart_validate("mart_temporal", bad.where("mes = 2")) == 1


def test_share_of_a_year_without_value(spark):
    rows = spark.createDataFrame([("a", 2020, 0.0), ("b", 2021, 3.0), ("c", 2021, 1.0)], "modalidad string, anio int, valor_total double")
    shares = {r["modalidad"]: r["participacion_pct"] for r in marts.participation_pct(rows).collect()}
    assert shares == {"a": None, "b": 75.0, "c": 25.0}


def test_missing_mart(spark, tmp_path):
    assert marts.mart_read(spark, marts.MARTS[0], str(tmp_path)) is None


def test_page_feed_takes_every_page_once(spark, landing, tmp_path):
    target, progress = Lake(str(tmp_path / "lake")), str(tmp_path / "progress")
    follow_pages(spark, str(landing), target, progress).awaitTermination()
    assert len(content(spark, target)) == 3
    follow_pages(spark, str(landing), target, progress).awaitTermination()
    assert run_log.run_history(spark, target.runs).count() == 1
    write_page(landing, 3, [PAGE_2[0] | {"id_contrato": "QZ-9"}, PAGE_2[0] | {"valor_pagado": "1"}])
    follow_pages(spark, str(landing), target, progress).awaitTermination()
    state = run_log.latest_state(run_log.run_history(spark, target.runs)).first()
    assert (state["inserted_records"], state["updated_records"]) == (1, 1)
    assert len(content(spark, target)) == 4


def test_a_full_load_without_keys_changes_nothing(spark, landing, tmp_path):
    target = Lake(str(tmp_path / "lake"))
    loads.load(spark, str(landing), target)
    before = content(spark, target, "silver"), content(spark, target)
    folder = tmp_path / "keyless"
    folder.mkdir()
    write_page(folder, 1, [{"nombre_entidad": "sin llave"}])
    with pytest.raises(quality.DataQualityError):
        loads.load_full(spark, pages.bronze_scan(spark, str(folder)), target)
    assert (content(spark, target, "silver"), content(spark, target)) == before


def test_a_bad_mart_does_not_replace_a_good_one(spark, tmp_path):
    mart = marts.MART["mart_temporal"]
    good = spark.createDataFrame([(2020, 3, 1, 5.0, 5.0)], "anio int, mes int, total_contratos bigint, valor_total double, valor_promedio double")
    assert marts.mart_write(mart, good, str(tmp_path)) == 1
    with pytest.raises(quality.DataQualityError):
        marts.mart_write(mart, good.selectExpr("anio", "13 AS mes", "total_contratos", "valor_total", "valor_promedio"), str(tmp_path))
    assert [r["mes"] for r in marts.mart_read(spark, mart, str(tmp_path)).collect()] == [3]


def test_an_amount_too_large_is_an_error(spark):
    rows = spark.createDataFrame([(1e27,), (5.0,)], "v double")
    for figure in (money.total("v"), money.mean("v")):
        with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
            rows.agg(figure).collect()
