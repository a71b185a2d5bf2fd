import pytest
from pyspark.sql import functions as F

from tendergrid.sources import versions
from tendergrid.sources.versions import Publication, PublishConflict


def rows_of(spark, years, start=0):
    return spark.createDataFrame([(f"k{start + i}", year, float(i)) for i, year in enumerate(years)], "k string, anio int, v double")


def content(spark, root, name="t"):
    return sorted(tuple(r) for r in versions.scan(spark, root, name).collect())


def publish(spark, root, rows, only=None, name="t"):
    with Publication(spark, root) as made:
        made.put(name, rows, "anio", only)
        return made.commit()


def test_nothing_is_seen_before_the_commit(spark, tmp_path):
    root = str(tmp_path)
    assert versions.current(spark, root).number == 0 and versions.scan(spark, root, "t") is None
    with Publication(spark, root) as made:
        table = made.put("t", rows_of(spark, [1, 2, 2]), "anio", profile={"large": F.col("v") > 0})
        assert versions.scan(spark, root, "t") is None and made.scan("t").count() == 3
        made.commit()
    assert {key: (p["rows"], p["profile"]) for key, p in table.parts.items()} == {"1": (1, {"large": 0}), "2": (2, {"large": 2})}
    assert table.profile() == {"large": 2}
    assert content(spark, root) == [("k0", 1, 0.0), ("k1", 2, 1.0), ("k2", 2, 2.0)]
    assert versions.current(spark, root).number == 1


def test_parts_are_replaced_and_removed(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, rows_of(spark, [1, 2, 3]))
    publish(spark, root, rows_of(spark, [2, 2, 9], 10), only=[2, 3])
    assert content(spark, root) == [("k0", 1, 0.0), ("k10", 2, 0.0), ("k11", 2, 1.0)]
    publish(spark, root, rows_of(spark, [2]).limit(0), only=[1, 2])
    assert content(spark, root) == [] and versions.scan(spark, root, "t").columns == ["k", "anio", "v"]


def test_new_columns_are_null_in_old_parts(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, rows_of(spark, [1, 2]))
    publish(spark, root, rows_of(spark, [2]).withColumn("w", F.lit("x")), only=[2])
    assert content(spark, root) == [("k0", 1, 0.0, None), ("k0", 2, 0.0, "x")]
    with pytest.raises(TypeError):
        publish(spark, root, rows_of(spark, [2]).withColumn("v", F.lit("x")), only=[2])


def test_a_part_without_a_value_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        publish(spark, str(tmp_path), spark.createDataFrame([("a", None)], "k string, anio int"))
    assert versions.scan(spark, str(tmp_path), "t") is None


def test_of_two_publications_one_wins(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, rows_of(spark, [1]))
    first, second = Publication(spark, root), Publication(spark, root)
    first.put("t", rows_of(spark, [5]), "anio")
    second.put("t", rows_of(spark, [6]), "anio")
    second.commit()
    with pytest.raises(PublishConflict), first:
        first.commit()
    assert content(spark, root) == [("k0", 6, 0.0)]
    assert not any("anio=5" in str(p) for p in tmp_path.rglob("*.parquet"))
    assert sorted(p.name for p in (tmp_path / "_manifests").glob("*.json")) == ["000000000001.json", "000000000002.json"]


def test_superseded_folders_go_and_others_stay(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, rows_of(spark, [1, 2]))
    publish(spark, root, rows_of(spark, [3]), name="other")
    old = versions.scan(spark, root, "t")
    publish(spark, root, rows_of(spark, [2], 7), only=[2])
    under_way = Publication(spark, root)
    under_way.put("t", rows_of(spark, [4]), "anio", [4])
    assert versions.expire(spark, root) == 0 and old.count() == 2
    assert versions.expire(spark, root, keep=1) == 1
    assert content(spark, root) == [("k0", 1, 0.0), ("k7", 2, 0.0)] and content(spark, root, "other") == [("k0", 3, 0.0)]
    under_way.commit()
    assert len(content(spark, root)) == 3


def test_partitions_are_pruned_and_counts_come_from_footers(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, rows_of(spark, [1, 2]))
    publish(spark, root, rows_of(spark, [2], 7), only=[2])
    plan = versions.scan(spark, root, "t").where("anio = 2")._jdf.queryExecution().executedPlan().toString()
    assert "(anio" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
