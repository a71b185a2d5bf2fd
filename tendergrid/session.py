"""Session defaults and the shared working folder."""

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the plans count on. Adaptive execution merges small shuffle
# partitions, splits the skewed side of a join, and sizes the output files of a
# REBALANCE; dates are compared in UTC; a cast that cannot hold its value fails. The JVM never compiles a method of more
# than 8000 bytecodes: a wide projection fused into one such method runs several
# times slower than the same projection split into small ones. A JSON number or
# object read as text has one spelling, however a page is read.
RUNTIME_SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.json.enableExactStringParsing": "false",
}

# Shuffle bytes per output file of a table write, and per task of the joins and sorts before it: rows take
# several times these bytes in memory, so larger tasks would spill (measured at 256m).
FILE_BYTES = "64m"
# Of written tables: row hashes and keys take a third less than with Spark's default.
COMPRESSION = "zstd"

_local_folder = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tendergrid")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return configure(builder.getOrCreate())


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, under spark.checkpoint.dir.

    Only a local session that names no such folder (a plain test) gets a
    machine-local one, which goes away with the process. On a cluster the
    executors would each write to a disk of their own, so there it is an error.
    """
    global _local_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder for master {master}")
        if _local_folder is None:
            _local_folder = tempfile.TemporaryDirectory(prefix="tendergrid-")
        root = _local_folder.name
    return f"{root.rstrip('/')}/tendergrid/{purpose}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def table_file_size(spark: SparkSession, size: str = FILE_BYTES):
    """Let a rebalanced write make files of this size instead of shuffle-partition size."""
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": size}):
        yield


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Runtime settings that hold inside the block only."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


# For rewriting stored files without a shuffle: a task reads some 16m of them, about as many rows as FILE_BYTES of
# a shuffle hold, and keeps a writer open per year, so rows are not sorted for that.
REWRITE = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.files.openCostInBytes": "64k",
    "spark.sql.files.minPartitionNum": "1",
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}
