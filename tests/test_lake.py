import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import write_page
from tendergrid.operators import quality
from tendergrid.plans import loads
from tendergrid.session import FILE_BYTES
from tendergrid.sources import lake, order_tables, pages, run_log

ROWS = [
    ("001", 2023, 1000.0, "Salud", dt.date(2023, 1, 15)),
    ("002", 2024, 2000.0, "IDU", dt.date(2024, 6, 1)),
    ("003", 2023, 3000.0, "Educación", dt.date(2023, 12, 1)),
]
SCHEMA = "id_contrato string, anio int, valor_contrato double, nombre_entidad string, fecha_firma date"


def per_year(rows):
    return {r["anio"]: r["registros"] for r in lake.rows_per_year(rows).collect()}


def test_pages(spark, landing):
    write_page(landing, 3, [])
    rows = pages.bronze_scan(spark, str(landing))
    assert rows.count() == 3
    assert rows.where("id_contrato = 'PX-17/A'").first()["urlproceso"].startswith('{"url"')


def test_pages_missing_or_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pages.bronze_scan(spark, str(tmp_path))
    write_page(tmp_path, 1, [])
    with pytest.raises(ValueError):
        pages.bronze_scan(spark, str(tmp_path))


def test_damaged_page_is_an_error(spark, tmp_path):
    (tmp_path / "socrata_page_000001_offset_0000000000.json").write_text('[{"id_contrato": "1"')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed|malformed"):
        pages.read_pages(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("bound", [{"page_rows": 100}, {"page_bytes": 50_000}])
def test_written_pages_hold_every_row_once(spark, tables, tmp_path, bound):
    rows = order_tables.page_rows(spark, tables)
    files = pages.write_pages(rows, str(tmp_path / "p"), **bound)
    back = pages.bronze_scan(spark, str(tmp_path / "p"), files)
    written = [json.loads(path.read_text()) for path in (tmp_path / "p").glob("_page=*/part-*")]
    assert len(written) == len(list((tmp_path / "p").glob("_page=*"))) > 10
    assert max(map(len, written)) <= bound.get("page_rows", 10**9)
    assert max(path.stat().st_size for path in (tmp_path / "p").glob("_page=*/part-*")) <= bound.get("page_bytes", 10**9)
    assert back.exceptAll(rows.select(*back.columns)).isEmpty()
    assert rows.select(*back.columns).exceptAll(back).isEmpty()


def test_a_large_page_is_read_in_ranges(spark, tables, tmp_path):
    """Small ranges cut elements, strings, escapes and nested objects at any byte."""
    rows = order_tables.page_rows(spark, tables).limit(300)
    odd = [
        {"id_contrato": "o1", "nombre_entidad": 'a "quoted\\" } ] [ { \\', "urlproceso": {"url": "https://x/}{", "n": [1, [2, {"a": "]}"}]]}},
        {"id_contrato": "o2", "objeto_del_contrato": "é\u2028𝄞" * 900 + "}" * 50, "valor_pagado": 12.5, "nombre_entidad": None},
        {},
    ]
    texts = [json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False) for r in rows.collect()]
    texts[7:7] = [json.dumps(r, ensure_ascii=False) for r in odd]
    texts[200:200] = [json.dumps(odd[0], indent=2)]
    (tmp_path / "socrata_page_1.json").write_text("\n [" + " ,\n".join(texts) + "\n]\n")
    (tmp_path / "socrata_page_2.json").write_text("[]")
    (tmp_path / "socrata_page_3.json").write_text("[" + texts[7] + "]")
    whole = sorted(map(str, pages.read_pages(spark, str(tmp_path)).collect()))
    assert len(whole) == 305
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for size in ("997b", "20000b", before):
            spark.conf.set(name, size)
            ranges = pages.read_pages(spark, str(tmp_path), whole_bytes=0)
            assert sorted(map(str, ranges.collect())) == whole
            if size == "20000b":
                pieces = pages._pieces(spark, str(tmp_path))
                longest = max(len(r["text"]) for r in pages._elements(pieces, pages._range_states(pieces)).collect())
                assert longest < 20_000 < (tmp_path / "socrata_page_1.json").stat().st_size / 5
        spark.conf.set(name, "997b")
        for damaged in ('[{"id_contrato": "1"', '[{"id_contrato": "1"}', '[{"id_contrato": "1}]', '{"id_contrato": "1"}\n', '[[{"id_contrato": "1"}]]', "[{} {}]", "[{]}]"):
            (tmp_path / "socrata_page_4.json").write_text(damaged)
            with pytest.raises(Exception, match="(?i)malformed"):
                pages.read_pages(spark, str(tmp_path), "socrata_page_4.json", whole_bytes=0).collect()
    finally:
        spark.conf.set(name, before)


def test_silver(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "silver")
    with pytest.raises(FileNotFoundError):
        lake.silver_scan(spark, path)
    lake.silver_write(rows, path)
    assert lake.silver_scan(spark, path).count() == 3
    with pytest.raises(PySparkException):
        lake.silver_write(rows, path)


def test_gold(spark, tmp_path):
    path = str(tmp_path / "gold")
    lake.gold_write_full(spark.createDataFrame(ROWS + [("004", 0, 1.0, "X", None)], SCHEMA), path)
    assert sorted(p.name for p in (tmp_path / "gold" / "gold").glob("publicado=*/anio=*")) == ["anio=0", "anio=2023", "anio=2024"]
    assert per_year(lake.gold_scan(spark, path)) == lake.year_counts(spark, path) == {0: 1, 2023: 2, 2024: 1}
    view = lake.gold_view(spark, path)
    assert spark.sql("SELECT COUNT(*) FROM contratos").first()[0] == 4
    assert view.count() == 4
    health = lake.dataset_health(spark, path).first()
    assert health["parquet_files"] == 3 and health["total_records"] == 4
    assert lake.dataset_health(spark, str(tmp_path / "none")).first()["parquet_files"] == 0


def test_view_without_files_is_a_warning(spark, tmp_path, caplog):
    assert lake.gold_view(spark, str(tmp_path / "nothing")) is None
    assert "no yearly partitions" in caplog.text


def test_incremental_write_touches_only_its_years(spark, tmp_path):
    path = str(tmp_path / "gold")
    lake.gold_write_full(spark.createDataFrame(ROWS, SCHEMA), path)
    before = {f for f in lake.gold_scan(spark, path).inputFiles() if "anio=2023" in f}
    changed = [("002", 2025, 5.0, "IDU", dt.date(2025, 1, 1))]
    lake.gold_write_incremental(spark.createDataFrame(changed, SCHEMA), path, [2024, 2025])
    assert per_year(lake.gold_scan(spark, path)) == lake.year_counts(spark, path) == {2023: 2, 2025: 1}
    assert {f for f in lake.gold_scan(spark, path).inputFiles() if "anio=2023" in f} == before and before


def test_years_can_be_rewritten_from_the_table_itself(spark, tmp_path):
    path = str(tmp_path / "gold")
    lake.gold_write_full(spark.createDataFrame(ROWS, SCHEMA), path)
    doubled = lake.gold_scan(spark, path).withColumn("valor_contrato", 2 * F.col("valor_contrato"))
    lake.gold_write_incremental(doubled, path, [2023])
    values = {r[0]: r[1] for r in lake.gold_scan(spark, path).select("id_contrato", "valor_contrato").collect()}
    assert values == {"001": 2000.0, "002": 2000.0, "003": 6000.0}


def test_partition_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id_contrato string, x int")
    new = spark.createDataFrame([("b", 2.5, "n"), ("c", 3.5, "n")], "id_contrato string, x double, y string")
    merged = {tuple(r) for r in lake.gold_partition_upsert(old, new).collect()}
    assert merged == {("a", 1.0, None), ("b", 2.5, "n"), ("c", 3.5, "n")}
    keyless = old.drop("id_contrato")
    assert lake.gold_partition_upsert(keyless, new).count() == 2


def test_silver_validate(spark, caplog):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert {tuple(r) for r in quality.silver_validate(rows).collect()} == {(2023, 2), (2024, 1)}
    with pytest.raises(quality.DataQualityError):
        quality.silver_validate(rows.where("false"))
    with pytest.raises(quality.DataQualityError):
        quality.silver_validate(rows.drop("anio"))
    quality.silver_validate(rows.drop("id_contrato"))
    assert "id_contrato" in caplog.text


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    history = run_log.run_history(spark, path)
    assert history.isEmpty() and run_log.full_load_needed(history).first()[0]
    runs = [("r1", "2024-01-01", "completed", "w1"), ("r2", "2024-01-02", "completed", "w2"), ("r3", "2024-01-03", "failed", None)]
    for run in runs:
        frame = spark.createDataFrame([run], "run_id string, timestamp string, status string, watermark string")
        run_log.run_history_append(frame, path)
    history = run_log.run_history(spark, path)
    assert history.count() == 3
    assert run_log.latest_state(history).first()["run_id"] == "r2"
    assert not run_log.full_load_needed(history).first()[0]


def test_contracts_are_spread_before_their_texts_are_made(spark, tables):
    rows = order_tables.contracts(spark, tables, by_year=True)
    plain = order_tables.contracts(spark, tables)
    assert rows.columns == plain.columns
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    text = rows._jdf.queryExecution().executedPlan().toString()
    # The join by supplier lies above that by order, so no text of a customer goes through the latter's shuffle.
    assert text.index("Suministro | ") < text.index("REBALANCE") < text.index("Join [o_custkey") < text.index("Join [o_orderkey")


def test_postings_hold_every_value_and_file_once(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = [(k, 2020 + i % 2, n, d) for i, (k, n, d) in enumerate([("a", "1", "x"), ("b", "1", None), ("c", None, "x"), ("d", "2", "x"), ("a", "1", "y")])]
    frame = spark.createDataFrame(rows, "id_contrato string, anio int, nit_entidad string, documento_proveedor string")
    lake.gold_write_full(frame.repartition(3), path)
    stored = lake.gold_scan(spark, path).withColumn("f", F.col("_metadata.file_path")).collect()
    wanted = {(r.anio, c, r[c], r.f.split("/gold/gold/")[1]) for r in stored for c in lake.LOOKED_UP if r[c] is not None}
    found = lake.versions.scan(spark, path, lake.FILES).collect()
    assert {(r.anio, r.columna, r.valor, r.archivo.removeprefix("gold/")) for r in found} == wanted
    assert sum(r.columna != "id_contrato" for r in found) == sum(w[1] != "id_contrato" for w in wanted)
    assert sorted(r.documento_proveedor for r in lake.gold_where(spark, path, "id_contrato", "a").collect()) == ["x", "y"]


def test_tables_of_a_load_are_spread_once(spark, tables, tmp_path, monkeypatch):
    """The yearly partitions come from the typed table, which lies by year already; only narrow postings are spread beside it."""
    spread, before = [], lake.spread_by_year
    monkeypatch.setattr(lake, "spread_by_year", lambda rows, *a: spread.append(len(rows.columns)) or before(rows, *a))
    target = loads.Lake(str(tmp_path / "lake"))
    landed = order_tables.page_rows(spark, tables, dt.date(1997, 6, 30)).limit(200)
    loads.load_full(spark, landed, target)
    assert sum(columns > 40 for columns in spread) == 1
    gold, silver = target.scan(spark, lake.GOLD), target.scan(spark, lake.SILVER)
    assert gold.exceptAll(silver.select(*gold.columns)).isEmpty() and gold.count() == silver.count()


def test_a_task_of_a_table_write_is_small():
    """256m of compressed rows were several times the memory of a task, and spilled."""
    assert FILE_BYTES == "64m"


def test_compressed_pages_hold_the_same_rows(spark, tables, tmp_path):
    rows = order_tables.page_rows(spark, tables)
    sizes = []
    for compression in ("none", "gzip"):
        folder = tmp_path / compression
        files = pages.write_pages(rows, str(folder), page_rows=500, compression=compression)
        back = pages.bronze_scan(spark, str(folder), files)
        assert back.exceptAll(rows.select(*back.columns)).isEmpty() and back.count() == rows.count()
        sizes.append(sum(path.stat().st_size for path in folder.glob("_page=*/part-*")))
    assert sizes[1] * 4 < sizes[0]
