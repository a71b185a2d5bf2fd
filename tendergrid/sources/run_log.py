"""Run history: one JSON line per run; the state is the latest completed line."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RUN_HISTORY_SCHEMA


def run_history_append(runs: DataFrame, path: str) -> None:
    known = [field.name for field in RUN_HISTORY_SCHEMA if field.name in runs.columns]
    runs.select(*known).write.mode("append").json(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_HISTORY_SCHEMA).json(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_HISTORY_SCHEMA)


def latest_state(history: DataFrame) -> DataFrame:
    """The latest completed run; no row means that a full load is needed."""
    return (
        history.where(F.col("status") == "completed")
        .orderBy(F.desc("timestamp"), F.desc("run_id"))
        .limit(1)
    )


def full_load_needed(history: DataFrame) -> DataFrame:
    """One boolean: no completed run yet, or one that left no watermark."""
    return latest_state(history).agg(
        (F.count("watermark") == 0).alias("full_load_needed")
    )


def has_completed_run(history: DataFrame) -> bool:
    return not latest_state(history).isEmpty()
