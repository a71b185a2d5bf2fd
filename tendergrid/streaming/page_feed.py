"""Upsert every page file once, as it lands."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.loads import Lake, load_batch, load_full
from ..schemas import BRONZE_SCHEMA
from ..sources.pages import PAGE_FILES
from ..sources.run_log import has_completed_run, run_history


def page_stream(spark: SparkSession, folder: str, files: str = PAGE_FILES) -> DataFrame:
    return (
        spark.readStream.schema(BRONZE_SCHEMA)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", files)
        .json(folder)
    )


def follow_pages(
    spark: SparkSession, folder: str, target: Lake, progress: str, files: str = PAGE_FILES
) -> StreamingQuery:
    """Take in all pages not seen before and stop.

    The progress folder remembers which pages are done, so a repeated or
    resumed run neither skips nor re-reads a page. The upsert compares hashes,
    so a batch that is replayed after a failure changes nothing twice.
    """

    def take_in(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        started = has_completed_run(run_history(spark, target.runs))
        (load_batch if started else load_full)(spark, batch, target)

    return (
        page_stream(spark, folder, files)
        .writeStream.foreachBatch(take_in)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
