"""The typed table and its yearly partitions: versioned tables of one lake folder.

Every write here is a publication (see versions.py): staged, measured, and made
visible by one rename. Several tables can share a publication, then readers see
either all of the load or nothing of it.
"""

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.merge import keep_unreplaced
from ..schemas import KEY, YEAR
from ..session import REWRITE, settings
from . import versions
from .versions import Publication, exists, remove

__all__ = ["exists", "remove"]

VIEW = "contratos"
SILVER, GOLD, FILES = "silver", "gold", "gold_archivos"
# Columns whose values are looked up one at a time.
LOOKED_UP = [KEY, "nit_entidad", "documento_proveedor"]
# Ends the name of the table that keeps a mart's counts; see plans/mart_changes.py.
STATE = "_estado"
# Shuffle bytes of a task that writes postings: sorted values compress to a few bytes each.
POSTINGS_BYTES = "16m"

log = logging.getLogger(__name__)


def spread_by_year(rows: DataFrame, year: str = YEAR) -> DataFrame:
    """Bring the rows of a year together for writing without tying a year to one task.

    REBALANCE shuffles by year; adaptive execution then cuts years that are
    too large into several tasks and merges the small ones, so a year holding
    a third of all rows neither becomes one task nor one file.
    """
    return rows.hint("rebalance", year)


def put_silver(made: Publication, rows: DataFrame, years: list[int] | None = None, spread: bool = True) -> versions.Table:
    """Stage the typed table, or some years of it, with its profile; see quality.profile.

    Rows read year by year from stored files need no shuffle (spread=False).
    """
    with settings(made.spark, {} if spread else REWRITE):
        return made.put(SILVER, spread_by_year(rows) if spread else rows, YEAR, years, quality.profile(rows))


def _postings(rows: DataFrame) -> DataFrame:
    """Year, column, value and file of the looked-up values in stored rows, by year and in order of the values.

    Shuffled and sorted are numbers of files and columns in place of their
    names. Their list comes to the driver, which plans a scan of as many files
    anyway. Keys are their rows' own, so only the other columns are freed of
    repeats first.
    """
    columns = sorted(c for c in LOOKED_UP if c in rows.columns)
    rows = rows.withColumn("archivo", versions.file_of(GOLD))
    files = sorted(row["archivo"] for row in rows.select("archivo").distinct().collect())
    numbers = rows.sparkSession.createDataFrame(list(enumerate(files)), "_archivo int, archivo string")
    rows = rows.join(F.broadcast(numbers), "archivo")

    def held(names):
        pairs = [F.struct(F.lit(columns.index(c)).alias("_columna"), F.col(c).cast("string").alias("valor")) for c in names]
        return rows.select(YEAR, "_archivo", F.inline(F.array(*pairs))).where(F.col("valor").isNotNull())

    own, others = [c for c in columns if c == KEY], [c for c in columns if c != KEY]
    parts = ([held(own)] if own else []) + ([held(others).distinct()] if others else [])
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Sorted by value, so that a lookup reads a few row groups of the postings.
    return spread_by_year(found).sortWithinPartitions(YEAR, "_columna", "valor").select(
        YEAR,
        F.get(F.split(F.lit("\n".join(files)), "\n"), F.col("_archivo")).alias("archivo"),
        F.get(F.array(*map(F.lit, columns)), F.col("_columna")).alias("columna"),
        "valor",
    )


def put_gold(made: Publication, rows: DataFrame, years: list[int] | None = None, spread: bool = True) -> versions.Table:
    """Stage yearly partitions, and for the columns looked up which files hold which value.

    Sorting by key inside a task gives each row group a narrow key range, so
    a lookup by contract skips nearly all of them. Rows that lie together by
    year already need no further shuffle (spread=False). Counts kept for marts go: whoever knows what changed brings
    them up to date and stages them again.
    """
    for name in [name for name in made.tables if name.endswith(STATE)]:
        del made.tables[name]
    rows = spread_by_year(rows) if spread else rows
    table = made.put(GOLD, rows.sortWithinPartitions(YEAR, KEY), YEAR, years)
    made.put(FILES, _postings(made.staged(GOLD)), YEAR, years, size=POSTINGS_BYTES)
    return table


def silver_write(rows: DataFrame, root: str, replace: bool = False) -> None:
    """Publish the typed table, by default only if there is none yet."""
    with Publication(rows.sparkSession, root) as made:
        if SILVER in made.tables and not replace:
            raise AnalysisException(f"{root} already holds a typed table")
        put_silver(made, rows)
        made.commit()


def silver_scan(spark: SparkSession, root: str) -> DataFrame:
    rows = versions.scan(spark, root, SILVER)
    if rows is None:
        raise FileNotFoundError(f"no typed table at {root}")
    return rows


def gold_write_full(rows: DataFrame, root: str, spread: bool = True) -> None:
    """Publish every year as a partition; replaces all years at once. For spread see put_gold."""
    with Publication(rows.sparkSession, root) as made:
        put_gold(made, rows, spread=spread)
        made.commit()


def gold_write_incremental(rows: DataFrame, root: str, years: list[int]) -> None:
    """Publish the affected years from the merged table; years that lost their last row go."""
    years = sorted({int(year) for year in years})
    if not years:
        return
    with Publication(rows.sparkSession, root) as made:
        put_gold(made, rows.where(F.col(YEAR).isin(years)), years)
        made.commit()


def gold_scan(spark: SparkSession, root: str, version: versions.Version | None = None) -> DataFrame:
    rows = versions.scan(spark, root, GOLD, version)
    if rows is None:
        raise FileNotFoundError(f"no yearly partitions at {root}")
    return rows


def files_holding(
    spark: SparkSession, root: str, column: str, value: str, version: versions.Version
) -> dict[int, list[str]] | None:
    """The files that hold a value, by year; None for a column without postings.

    Their names come to the driver, which plans a scan of as many files anyway.
    """
    if column not in LOOKED_UP or FILES not in version.tables:
        return None
    postings = versions.scan(spark, root, FILES, version)
    held = postings.where((F.col("columna") == column) & (F.col("valor") == value)).select(YEAR, "archivo").distinct()
    found: dict[int, list[str]] = {}
    for row in held.collect():
        found.setdefault(row[YEAR], []).append(row["archivo"])
    return found


def gold_where(spark: SparkSession, root: str, column: str, value: str) -> DataFrame:
    """The contracts with one value of a looked-up column, read from the files that hold it only.

    A column without postings is searched in all files.
    """
    version = versions.current(spark, root)
    if GOLD not in version.tables:
        raise FileNotFoundError(f"no yearly partitions at {root}")
    held = files_holding(spark, root, column, value, version)
    files = None if held is None else sorted(name for names in held.values() for name in names)
    return versions.scan(spark, root, GOLD, version, files).where(F.col(column) == value)


def gold_view(spark: SparkSession, root: str, name: str = VIEW) -> DataFrame | None:
    """Register all years as a view. A folder without data is only a warning."""
    try:
        rows = gold_scan(spark, root)
    except FileNotFoundError as problem:
        log.warning("%s", problem)
        return None
    rows.createOrReplaceTempView(name)
    return rows


def gold_partition_upsert(existing: DataFrame, updated: DataFrame) -> DataFrame:
    """Rows of a partition after an upsert: incoming keys replace, columns may differ.

    Without the key column in both, the incoming rows replace everything.
    """
    if KEY not in existing.columns or KEY not in updated.columns:
        return updated
    return keep_unreplaced(existing, updated.select(KEY)).unionByName(
        updated, allowMissingColumns=True
    )


def rows_per_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col(YEAR).cast("bigint").alias(YEAR)).agg(
        F.count(F.lit(1)).alias("registros")
    )


def year_counts(
    spark: SparkSession, root: str, table: str = GOLD, version: versions.Version | None = None
) -> dict[int, int]:
    """Rows of each year as the manifest has them; nothing is read."""
    found = (version or versions.current(spark, root)).tables.get(table)
    return {int(year): part["rows"] for year, part in sorted(found.parts.items())} if found else {}


def dataset_health(spark: SparkSession, root: str, table: str = GOLD) -> DataFrame:
    """Number of data files with rows and number of rows, counted from file footers when they were written."""
    found = versions.current(spark, root).tables.get(table)
    figures = (found.total("files"), found.total("rows")) if found else (0, 0)
    return spark.createDataFrame([figures], "parquet_files bigint, total_records bigint")
