"""What the operators share: reading tables, staged tables, session limits."""

import contextlib
import contextvars
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendergrid import session
from tendergrid.sources import versions

# The columns of `documents`; pipeline stages return exactly these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@dataclass
class Staged:
    """Folders of tables that go at the end of a block, and of those that outlast it."""

    passing: list[str] = field(default_factory=list)
    lasting: list[str] = field(default_factory=list)


_block: contextvars.ContextVar[Staged | None] = contextvars.ContextVar("block", default=None)


def staged(rows: DataFrame, purpose: str, lasting: bool = False) -> DataFrame:
    """Write rows under the shared folder and read them back: cuts the lineage and survives lost executors.

    Inside `passing_tables` the table goes when that ends, unless it is lasting.
    """
    spark = rows.sparkSession
    folder = session.work_folder(spark, f"llm-{purpose}")
    rows.write.parquet(folder)
    block = _block.get()
    if block is not None:
        (block.lasting if lasting else block.passing).append(folder)
    return spark.read.schema(rows.schema).parquet(folder)


@contextlib.contextmanager
def passing_tables(spark: SparkSession):
    """Remove the tables staged inside, lasting ones aside, once the block has succeeded.

    What leaves the block must be read from lasting tables alone; those go with the
    block around it, if there is one. After an error all tables stay.
    """
    block = Staged()
    token = _block.set(block)
    try:
        yield block
    finally:
        _block.reset(token)
    for folder in block.passing:
        versions.remove(spark, folder)
    if _block.get() is not None:
        _block.get().passing.extend(block.lasting)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
