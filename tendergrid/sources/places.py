"""Whole rows of stored tables found again by their place, so that shuffles carry keys and places only.

A row's place is its file and its number in there. What is decided by key is
decided on narrow rows that have a place; a set of places is then kept as marks,
one bit a row in blocks of 32 768 rows of a file. Marks are sent to every task,
which takes or leaves whole rows as it reads them: those are neither shuffled nor
sorted. More than MOST_MARKS marks are not sent, and the join is Spark's to plan.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import YEAR
from ..session import COMPRESSION, REWRITE, settings
from . import versions

FILE, ROW = "_archivo", "_fila"
PLACE = [FILE, ROW]
# 4 KB each: 32 MB, for 262 million rows.
MOST_MARKS = 8_000
# So many bytes are cheaply shuffled, and end up in fewer files.
SMALL = 64 << 20
_NAME = "por_anio"


class Stored:
    """A stored table with a part per year, whose rows have places."""

    def __init__(self, spark: SparkSession, root: str, name: str, table: versions.Table):
        self.spark, self.root, self.name, self.table = spark, root, name, table
        self._known = None

    def scan(self) -> DataFrame:
        return versions.scan(self.spark, self.root, self.name, versions.Version(0, {self.name: self.table}))

    def size(self) -> int:
        """Bytes of the files."""
        return sum(versions.size(self.spark, f"{self.root}/{part['folder']}") for part in self.table.parts.values())

    def rows(self, years: list[int] | None = None) -> DataFrame:
        """Whole rows, all or those of some years, year by year and with their places; files have their paths."""
        kept = {key: part for key, part in self.table.parts.items() if years is None or int(key) in years}
        table = versions.Table(self.table.by, self.table.schema, kept)
        return versions.scan_apart(self.spark, self.root, self.name, table, _with_place)

    def _numbers(self) -> DataFrame:
        """The files by number. Their list comes to the driver, which plans a scan of as many files anyway."""
        if self._known is None:
            files = _with_place(self.scan()).select(FILE).distinct().collect()
            self._known = sorted(row[FILE] for row in files)
        return self.spark.createDataFrame(list(enumerate(self._known)), f"_numero int, {FILE} string")

    def placed(self, *columns: str) -> DataFrame:
        """Some columns of all rows and their places; files have numbers, which take less room than paths."""
        rows = _with_place(self.scan()).select(*columns, *PLACE).join(F.broadcast(self._numbers()), FILE)
        return rows.select(*columns, F.col("_numero").alias(FILE), ROW)

    def marks(self, places: DataFrame) -> DataFrame:
        """Marks of places; their files have numbers, as in placed."""
        block = F.bitmap_bucket_number(ROW).alias("_bloque")
        bits = F.bitmap_construct_agg(F.bitmap_bit_position(ROW)).alias("_bits")
        marks = places.groupBy(F.col(FILE).alias("_numero"), block).agg(bits)
        return marks.join(F.broadcast(self._numbers()), "_numero").select(F.col(FILE).alias("_en"), "_bloque", "_bits")


def _with_place(rows: DataFrame) -> DataFrame:
    if not rows.inputFiles():
        return rows.select("*", F.lit(None).cast("string").alias(FILE), F.lit(None).cast("bigint").alias(ROW))
    # From one on, since bitmap functions put number zero into a block of its own.
    number = F.col("_metadata.row_index") + 1
    return rows.select("*", F.col("_metadata.file_path").alias(FILE), number.alias(ROW))


def stored(rows: DataFrame, path: str) -> Stored:
    """Write rows to a folder per year, from the tasks that have them: small files, to be read again soon."""
    spark = rows.sparkSession
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": REWRITE["spark.sql.maxConcurrentOutputFileWriters"]}):
        # Row groups a task of a rewrite can hold.
        rows.write.option("compression", COMPRESSION).option("parquet.block.size", 16 << 20).partitionBy(YEAR).parquet(f"{path}/{_NAME}")
    folders = [found.rsplit("/", 1)[1] for found in versions.listed(spark, f"{path}/{_NAME}/{YEAR}=*")]
    parts = {folder.split("=")[1]: {"folder": f"{_NAME}/{folder}"} for folder in folders}
    return Stored(spark, path, _NAME, versions.Table(YEAR, rows.schema.json(), parts))


def few(marks: DataFrame) -> bool:
    """Whether marks can be sent to every task."""
    return marks.count() <= MOST_MARKS


def sent(marks: DataFrame) -> DataFrame:
    return F.broadcast(marks) if few(marks) else marks


def marked() -> Column:
    """Whether a mark holds a row of Stored.rows: what to join them by."""
    return F.expr(
        f"{FILE} = _en AND bitmap_bucket_number({ROW}) = _bloque AND getbit(int(conv(hex("
        f"substring(_bits, int(bitmap_bit_position({ROW}) div 8) + 1, 1)), 16, 10)), int(bitmap_bit_position({ROW}) % 8)) = 1"
    )


def at(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows that marks hold."""
    return rows.join(sent(marks), marked(), "left_semi")
