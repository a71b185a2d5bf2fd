"""Versioned tables: new files beside the old ones, made visible by one rename.

All tables of a root folder share a chain of numbered manifests. A manifest
names, for every part (a year, a run) of every table, the folder that holds it,
its files, rows and bytes, and the schema of the table. A publication writes new
parts into folders of its own, can be read and checked as if it were committed,
and becomes visible for all tables at once when its manifest is renamed to the
next number. A publication that dies before leaves what readers see untouched.
Two that start from the same version cannot both commit.

Readers resolve the newest manifest and read its folders only, with partition
pruning. Superseded folders stay until `expire`, so running queries keep theirs.

A manifest has one entry per part, not per file or row: for a table by year at
most a few thousand. Counts come from the footers of the files just written.
The rename is atomic where the file system's is (HDFS, local disks).
"""

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import COMPRESSION, FILE_BYTES, table_file_size

# Folder level that holds what one publication wrote, and the folder of manifests.
TAG = "publicado"
MANIFESTS = "_manifests"
# So many scans at most make up a table read part by part.
MOST_SCANS = 64


class PublishConflict(RuntimeError):
    """Another publication was committed since this one started."""


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _path(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _path(spark, path)
    files.delete(target, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder."""
    files, target = _path(spark, path)
    return files.getContentSummary(target).getLength()


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order."""
    files, target = _path(spark, pattern)
    return sorted(found.getPath().toString() for found in files.globStatus(target) or [])


@dataclass(frozen=True)
class Table:
    """One table of a version: the column its parts differ in, its schema, and its parts by their value."""

    by: str
    schema: str
    parts: dict[str, dict] = field(default_factory=dict)

    def total(self, figure: str) -> int:
        return sum(part[figure] for part in self.parts.values())

    def profile(self) -> dict[str, int]:
        """The figures of all parts, added up."""
        added = {}
        for part in self.parts.values():
            for name, value in part["profile"].items():
                added[name] = added.get(name, 0) + value
        return added


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, Table]


def _manifests(spark: SparkSession, root: str) -> list[str]:
    return listed(spark, f"{root}/{MANIFESTS}/[0-9]*.json")


def _loaded(spark: SparkSession, path: str) -> Version:
    files, target = _path(spark, path)
    stream = files.open(target)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(found["number"], {name: Table(**table) for name, table in found["tables"].items()})


def current(spark: SparkSession, root: str) -> Version:
    """The newest version; number 0 without tables if nothing was ever published."""
    known = _manifests(spark, root.rstrip("/"))
    return _loaded(spark, known[-1]) if known else Version(0, {})


def _scan(spark: SparkSession, root: str, name: str, table: Table, files: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(table.schema))
    paths = [part["folder"] for _, part in sorted(table.parts.items())] if files is None else files
    if not paths:
        return spark.createDataFrame([], schema)
    base = f"{root}/{name}"
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{root}/{path}" for path in paths]).select(*schema.names)


def scan_apart(
    spark: SparkSession, root: str, name: str, table: Table, made: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """The table part by part, so that no task reads rows of two; very many parts are taken some at a time.

    made is done to the rows of each scan, where they still know their files.
    """
    keys = sorted(table.parts)
    step = max(1, -(-len(keys) // MOST_SCANS))
    groups = [keys[at : at + step] for at in range(0, len(keys), step)] or [[]]
    each = [replace(table, parts={key: table.parts[key] for key in group}) for group in groups]
    return reduce(DataFrame.unionAll, [made(_scan(spark, root, name, some)) for some in each])


def scan(spark: SparkSession, root: str, name: str, version: Version | None = None, files: list[str] | None = None) -> DataFrame | None:
    """The table as of a version, by default the newest; only the given files of it, if any are given.

    None if the table was never published.
    """
    root = root.rstrip("/")
    table = (version or current(spark, root)).tables.get(name)
    return None if table is None else _scan(spark, root, name, table, files)


def file_of(name: str) -> Column:
    """The file a row was read from, the way `scan` takes it."""
    inside = F.substring_index(F.col("_metadata.file_path"), f"/{name}/{TAG}=", -1)
    return F.concat(F.lit(f"{name}/{TAG}="), inside)


def _joined_schema(old: StructType, new: StructType) -> StructType:
    known = {column.name: column.dataType for column in old}
    for column in new:
        if known.get(column.name, column.dataType) != column.dataType:
            raise TypeError(f"{column.name} was {known[column.name].simpleString()}, now {column.dataType.simpleString()}")
    return StructType([*old, *[column for column in new if column.name not in known]])


class Publication:
    """New parts of tables, readable and checkable before all of them become visible together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base = current(spark, self.root)
        self.tables = dict(self.base.tables)
        self.folders: list[str] = []
        self.committed = False
        self.tag = f"v{self.base.number + 1:06d}-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> "Publication":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None and not self.committed:
            self.abandon()

    def scan(self, name: str) -> DataFrame | None:
        """The table as it will be once this publication is committed."""
        table = self.tables.get(name)
        return None if table is None else _scan(self.spark, self.root, name, table)

    def staged(self, name: str, apart: bool = False) -> DataFrame:
        """Only the parts of the table that this publication wrote; apart as scan_apart has them."""
        table = self.tables[name]
        fresh = {key: part for key, part in table.parts.items() if f"{TAG}={self.tag}" in part["folder"]}
        return (scan_apart if apart else _scan)(self.spark, self.root, name, Table(table.by, table.schema, fresh))

    def put(self, name: str, rows: DataFrame, by: str, only: list | None = None, profile: dict[str, Column] | None = None, size: str = FILE_BYTES) -> Table:
        """Write rows, one part per value of `by`; replaces the whole table, or only the named parts.

        A named part without rows goes. rows may read the same table. profile
        adds figures per part (sums over rows), taken from the files written.
        size bounds the shuffle bytes of a task; rows that compress well need a smaller one.
        """
        before = self.tables.get(name)
        if only is not None:
            rows = rows.where(F.col(by).isin([int(v) if isinstance(v, bool) else v for v in only]))
        number = sum(f"/{name}/" in f"/{folder}" for folder in self.folders)
        folder = f"{name}/{TAG}={self.tag}" + (f"-{number}" if number else "")
        self.folders.append(folder)
        with table_file_size(self.spark, size):
            rows.write.option("compression", COMPRESSION).partitionBy(by).parquet(f"{self.root}/{folder}")
        schema = rows.schema
        parts = self._measured(folder, schema, by, profile or {})
        if only is not None and before is not None:
            schema = _joined_schema(StructType.fromJson(json.loads(before.schema)), schema)
            replaced = {str(value) for value in only}
            parts = {key: part for key, part in before.parts.items() if key not in replaced} | parts
        self.tables[name] = Table(by, schema.json(), parts)
        return self.tables[name]

    def _measured(self, folder: str, schema: StructType, by: str, profile: dict[str, Column]) -> dict[str, dict]:
        """Files, rows and bytes of each part. Without a profile only file footers are read."""
        path = f"{self.root}/{folder}"
        written = self.spark.read.schema(schema).parquet(path)
        file = F.col("_metadata.file_path").alias("file")
        sums = [F.sum(F.coalesce(figure.cast("bigint"), F.lit(0))).alias(name) for name, figure in profile.items()]
        per_file = written.groupBy(F.col(by).alias("part"), file).agg(
            F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"), *sums
        )
        totals = [F.sum(name).alias(name) for name in ("rows", "bytes", *profile)]
        per_part = per_file.groupBy("part").agg(F.count(F.lit(1)).alias("files"), *totals)
        # One row per part.
        found = per_part.collect()
        if any(row["part"] is None for row in found):
            raise ValueError(f"rows of {folder} have no {by}")
        return {
            str(row["part"]): {
                "folder": f"{folder}/{by}={row['part']}",
                **{figure: row[figure] for figure in ("files", "rows", "bytes")},
                "profile": {figure: row[figure] for figure in profile},
            }
            for row in found
        }

    def commit(self) -> Version:
        """Make everything visible at once; fails if another publication got there first."""
        made = Version(self.base.number + 1, self.tables)
        text = json.dumps({"number": made.number, "tables": {name: vars(table) for name, table in made.tables.items()}})
        final = f"{self.root}/{MANIFESTS}/{made.number:012d}.json"
        waiting = f"{self.root}/{MANIFESTS}/.{self.tag}"
        files, temporary = _path(self.spark, waiting)
        _, target = _path(self.spark, final)
        stream = files.create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            # Without the option to overwrite, the rename fails if the number is taken.
            context.rename(temporary, target, plain)
        except Exception as problem:
            files.delete(temporary, False)
            if exists(self.spark, final):
                raise PublishConflict(f"version {made.number} of {self.root} was published meanwhile") from problem
            raise
        self.committed = True
        return made

    def abandon(self) -> None:
        """Remove what was written; the visible version is untouched."""
        for folder in self.folders:
            remove(self.spark, f"{self.root}/{folder}")


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove folders that none of the newest `keep` versions uses; returns how many.

    Folders of a publication still under way carry a higher number and stay.
    """
    root = root.rstrip("/")
    known = _manifests(spark, root)
    kept = [_loaded(spark, path) for path in known[-max(1, keep) :]]
    if not kept:
        return 0
    used = {part["folder"] for version in kept for table in version.tables.values() for part in table.parts.values()}
    gone = 0
    for path in listed(spark, f"{root}/*/{TAG}=v*/*=*"):
        folder = "/".join(path.split("/")[-3:])
        if folder not in used and int(re.search(rf"{TAG}=v(\d+)", folder)[1]) <= kept[-1].number:
            remove(spark, path)
            gone += 1
    for path in known[: -max(1, keep)]:
        remove(spark, path)
    return gone
