"""Full and incremental loads from landing pages to yearly partitions, marts and run history.

A load stages the typed table, the yearly partitions, the marts and the rejected
rows, checks them, and publishes all of it by one rename (sources/versions.py).
A load that dies or fails a check at any earlier point changes nothing that
readers see, and repeating it brings the tables to the same state. The line in
the run history follows the rename; a run that dies in between is repeated by
the next one, which finds nothing left to change.
"""

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators import merge, quality
from ..operators.predicates import due_since
from ..operators.transform import bronze_to_silver
from ..schemas import KEY, ROW_HASH, RUN_HISTORY_SCHEMA, UPDATED_AT, YEAR
from ..session import COMPRESSION, REWRITE, settings, work_folder
from ..sources import lake, pages, places, run_log, versions
from .mart_changes import weighted
from .marts import MARTS, mart_read, put_marts

REJECTED = "rejected"


@dataclass(frozen=True)
class Lake:
    """Where the tables live: any folder all executors can reach."""

    root: str

    @property
    def runs(self) -> str:
        return f"{self.root.rstrip('/')}/runs"

    def scan(self, spark: SparkSession, table: str) -> DataFrame | None:
        """A table (silver, gold, a mart, rejected) as of the newest load."""
        return versions.scan(spark, self.root, table)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


class _Run:
    """One line of run history, written when the run ends."""

    def __init__(self, spark: SparkSession, target: Lake):
        self.spark, self.target = spark, target
        self.run_id = _now().strftime("run_%Y%m%d_%H%M%S_%f")
        self.started = time.monotonic()

    def log(self, status: str, **figures) -> dict:
        entry = {
            "run_id": self.run_id,
            "timestamp": _now().isoformat(),
            "duration_seconds": round(time.monotonic() - self.started, 2),
            "status": status,
            **figures,
        }
        row = tuple(entry.get(column.name) for column in RUN_HISTORY_SCHEMA)
        line = self.spark.createDataFrame([row], RUN_HISTORY_SCHEMA)
        run_log.run_history_append(line, self.target.runs)
        return entry


def _put_rejected(made: versions.Publication, rows: DataFrame, run: _Run) -> None:
    """Keep the rows without a key, with the run that met them and the reason; they become visible with the load."""
    kept = merge.without_key(rows).withColumns({"run_id": F.lit(run.run_id), "motivo": F.lit(f"{KEY} nulo")})
    made.put(REJECTED, kept, "run_id", [run.run_id])


class _Scratch:
    """Tables in the shared work folder, for the time of a load.

    Later steps then start from files: a lost executor costs a re-read, not
    the whole lineage, and the planner knows the size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def _path(self, purpose: str) -> str:
        self.paths.append(work_folder(self.spark, purpose))
        return self.paths[-1]

    def stored(self, rows: DataFrame, purpose: str) -> DataFrame:
        """Write rows and read them from there."""
        path = self._path(purpose)
        rows.write.option("compression", COMPRESSION).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def placed(self, rows: DataFrame, purpose: str) -> places.Stored:
        """Write typed rows by year, to be found again by their place."""
        return places.stored(rows, self._path(purpose))

    def remove(self) -> None:
        while self.paths:
            lake.remove(self.spark, self.paths.pop())


# Columns that decide which version of a contract stands, and where the version of the table lies.
_VERSION = [KEY, UPDATED_AT, ROW_HASH, YEAR]
_PRIOR = ["_archivo_previo", "_fila_previa"]


def _versions(table: places.Stored) -> DataFrame:
    """The narrow rows that decisions are taken on. A hash takes half the room as bytes; one that is none is NULL."""
    return table.placed(*_VERSION).withColumn(ROW_HASH, cleaning.hash_bytes(F.col(ROW_HASH)))


def _put_silver(
    made: versions.Publication,
    kept: tuple[places.Stored, DataFrame],
    come: tuple[places.Stored, DataFrame] | None = None,
    years: list[int] | None = None,
) -> versions.Table:
    """Stage the typed table from stored rows but those at some marks, and from others at theirs.

    Rows come year by year. They are shuffled only if they are few, for a file
    a year, or if there are too many marks to be sent to every task.
    """
    table, marks = kept
    rows = merge.keep_unreplaced(merge.with_key(table.rows(years)), places.sent(marks), places.marked())
    if come:
        rows = merge.union_relaxed(rows, places.at(come[0].rows(), come[1]))
    sides = [kept, come] if come else [kept]
    small = sum(stored.size() for stored, _ in sides) < places.SMALL
    spread = small or not all(places.few(marks) for _, marks in sides)
    return lake.put_silver(made, rows.drop(*places.PLACE), years, spread)


def _put_gold(made: versions.Publication, years: list[int] | None = None) -> None:
    """The typed table lies by year, so its years are read one by one and need no shuffle."""
    with settings(made.spark, REWRITE):
        lake.put_gold(made, made.staged(lake.SILVER, apart=True), years, spread=False)


def _failed_casts(figures: dict) -> dict[str, int]:
    return {name.removeprefix("x_"): value for name, value in figures.items() if name.startswith("x_") and value}


def _missing(table: versions.Table) -> dict[str, int]:
    return {name: value for name, value in table.profile().items() if name != quality.NO_FIT}


def _publish(made: versions.Publication) -> None:
    made.commit()
    for mart in MARTS:
        mart_read(made.spark, mart, made.root)
    versions.expire(made.spark, made.root)


def load_full(spark: SparkSession, landed: DataFrame, target: Lake) -> dict:
    """Landing rows to a new typed table, all yearly partitions and all marts.

    Rows that all lack a key, or an amount that no total can hold, leave the
    tables of earlier runs as they are.
    """
    run, scratch = _Run(spark, target), _Scratch(spark)
    try:
        with versions.Publication(spark, target.root) as made:
            seen = Observation()
            read = Observation()
            counted = landed.observe(read, F.count(F.lit(1)).alias("rows"), *quality.cast_failure_counts(landed.columns))
            typed = bronze_to_silver(counted).observe(
                seen, F.count_if(F.col(KEY).isNull()).alias("rejected"), F.max(UPDATED_AT).alias("watermark")
            )
            typed = scratch.placed(typed, "landed")
            repeated = scratch.stored(merge.repeated_keys(typed.scan()), "repeated")
            older = merge.superseded(_versions(typed), repeated, places.PLACE)
            silver = _put_silver(made, (typed, scratch.stored(typed.marks(older), "older")))
            if not silver.total("rows"):
                raise quality.DataQualityError("the typed table is empty")
            quality.check_amounts(silver.profile())
            if seen.get["rejected"]:
                _put_rejected(made, typed.scan(), run)
            scratch.remove()
            _put_gold(made)
            marts = put_marts(made, made.scan(lake.GOLD))
            _publish(made)
        per_year = lake.year_counts(spark, target.root)
        total = silver.total("rows")
        entry = run.log(
            "completed",
            extract_records=read.get["rows"],
            inserted_records=total,
            updated_records=0,
            unchanged_records=0,
            stale_records=0,
            rejected_records=seen.get["rejected"],
            years_affected=sorted(per_year),
            watermark=seen.get["watermark"],
            silver_records=total,
            gold_records=sum(per_year.values()),
            missing_values=_missing(silver),
            failed_casts=_failed_casts(read.get),
        )
        return entry | {"years": per_year, "marts": marts}
    except Exception:
        run.log("failed")
        raise
    finally:
        scratch.remove()


def load_batch(
    spark: SparkSession, landed: DataFrame, target: Lake, since: str | None = None
) -> dict:
    """Upsert landing rows: only years with a change are rewritten in the tables, only groups with one in the marts."""
    run, scratch = _Run(spark, target), _Scratch(spark)
    try:
        with versions.Publication(spark, target.root) as made:
            read = Observation()
            counted = landed.observe(read, *quality.cast_failure_counts(landed.columns))
            batch = scratch.placed(due_since(bronze_to_silver(counted), since), "batch")
            typed = batch.scan()
            before = made.tables[lake.SILVER]
            silver = places.Stored(spark, made.root, lake.SILVER, before)
            keys = merge.with_key(typed).select(KEY)
            known = _versions(silver).withColumnsRenamed(dict(zip(places.PLACE, _PRIOR, strict=True)))
            verdict = merge.classify(known, merge.latest_versions(_versions(batch)), keys, _PRIOR)
            verdict = scratch.stored(verdict.drop(KEY, UPDATED_AT, ROW_HASH), "changes")
            counts = merge.merge_metrics(verdict).first().asDict()
            extracted = typed.agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(F.col(KEY).isNull()).alias("rejected"),
            ).first()
            previous = run_log.latest_state(run_log.run_history(spark, target.runs)).first()
            watermark = merge.new_watermark(typed, previous["watermark"] if previous else None).first()["watermark"]
            if extracted["rejected"]:
                _put_rejected(made, typed, run)
            years = sorted(row[YEAR] for row in merge.affected_years(verdict).collect())
            marts = {mart.name: made.tables[mart.name].total("rows") for mart in MARTS if mart.name in made.tables}
            table = before
            if years:
                replaced = verdict.where(F.col(merge.ACTION) == merge.UPDATED).select(*_PRIOR)
                replaced = replaced.withColumnsRenamed(dict(zip(_PRIOR, places.PLACE, strict=True)))
                replaced = scratch.stored(silver.marks(replaced), "replaced")
                fresh = scratch.stored(batch.marks(merge.only_actions(verdict, merge.INSERTED, merge.UPDATED)), "fresh")
                table = _put_silver(made, (silver, replaced), (batch, fresh), years)
                quality.check_amounts(table.profile())
                _check_counts(before.total("rows"), table.total("rows"), counts[merge.INSERTED])
                gone = places.at(silver.rows(years), replaced)
                with settings(spark, REWRITE):
                    changes = scratch.stored(weighted(gone, places.at(batch.rows(), fresh)), "mart-changes")
                _put_gold(made, years)
                marts = put_marts(made, made.scan(lake.GOLD), years, changes)
            if made.folders:
                _publish(made)
        entry = run.log(
            "completed",
            extract_records=extracted["rows"],
            inserted_records=counts[merge.INSERTED],
            updated_records=counts[merge.UPDATED],
            unchanged_records=counts[merge.UNCHANGED],
            stale_records=counts[merge.STALE],
            rejected_records=extracted["rejected"],
            years_affected=years,
            watermark=watermark,
            silver_records=table.total("rows"),
            gold_records=sum(lake.year_counts(spark, target.root).values()),
            missing_values=_missing(table),
            failed_casts=_failed_casts(read.get),
        )
        return entry | {"marts": marts}
    except Exception:
        run.log("failed")
        raise
    finally:
        scratch.remove()


def _check_counts(before: int, after: int, inserted: int) -> None:
    """Rows counted in the files of the new version against what the batch was to do."""
    quality.check_row_count(before, after)
    if after != before + inserted:
        raise quality.DataQualityError(f"{after} rows after the merge, {before} and {inserted} new ones expected")


def load(spark: SparkSession, pages_folder: str, target: Lake, files: str = pages.PAGE_FILES) -> dict:
    """Full load on the first run or when no watermark is known, otherwise an upsert.

    An upsert looks at what was updated since the watermark of the last
    completed run, less the lookback, and at rows without an update time.
    """
    landed = pages.bronze_scan(spark, pages_folder, files)
    state = run_log.latest_state(run_log.run_history(spark, target.runs)).first()
    if state is None or state["watermark"] is None:
        return load_full(spark, landed, target)
    return load_batch(spark, landed, target, since=state["watermark"])
