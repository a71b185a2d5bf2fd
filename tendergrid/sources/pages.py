"""Landing pages: JSON files that each hold one array of contract objects.

An array is one JSON document, so Spark's own reader gives a page to one task.
Here pages are read in byte ranges, cut at closing braces: text between two of
them is a piece. Whether a brace closes an element depends on what came before,
but only through two facts, whether a string is open and how many brackets are.
A first pass sums up per byte range how those facts change (for either state of
the string at its start); adding up the sums in order gives the state at the
start of every range, one short row each. In the second pass every range puts
its own elements together. The text at its ends, which belongs to an element
shared with a neighbour, is joined by the number of the element. So a page of
any size is read by as many tasks as it has ranges, and no value holds more than
one element.
"""

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BRONZE_SCHEMA

# Executors need not have this package: what a task runs travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the name pattern of the page files.
PAGE_FILES = "socrata_page_*.json"
# A written page has at most so many rows and, unless one row is larger, so many bytes.
PAGE_ROWS, PAGE_BYTES = 50_000, 64 << 20
# Larger pages are read in byte ranges: in parallel, but at several times the work.
WHOLE_BYTES = 256 << 20


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pieces of text between closing braces, with the byte range they come from."""
    return spark.read.option("lineSep", "}").text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


_ESCAPED = re.compile(r"\\.", re.S)


def _changes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How pieces, each with the brace that ends it, change string state and depth.

    Parity of the string delimiters, then opened less closed brackets if no
    string, and if a string, is open at the start of the piece. The brace counts
    unless it is part of a string; no piece holds another.
    """
    rows = np.empty((len(texts), 3), np.int64)
    for i, text in enumerate(texts):
        parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
        odd = len(parts) % 2 == 0
        even, others = "".join(parts[::2]), "".join(parts[1::2])
        rows[i] = (
            odd,
            even.count("{") + even.count("[") - even.count("]") - (not odd),
            others.count("{") + others.count("[") - others.count("]") - odd,
        )
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _ranges(batches, columns):
    """Stretches of a batch that come from one byte range of one file."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = {name: batch.column(name) for name in columns}
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        cut = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1] or starts[i] != starts[i - 1]]
        for low, high in zip(cut, [*cut[1:], len(files)], strict=True):
            yield files[low], starts[low], {name: column.slice(low, high - low) for name, column in data.items()}


def _running(quotes: np.ndarray, outside: np.ndarray, inside: np.ndarray, string: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """String state and depth after each piece."""
    after = (string + np.cumsum(quotes)) % 2
    before = (after - quotes) % 2
    return after, depth + np.cumsum(np.where(before == 1, inside, outside))


def _range_sums(pieces: DataFrame) -> DataFrame:
    """Per byte range: parity of its string delimiters and change of depth for either string state at its start."""

    def run(batches):
        sums = {}
        for file, start, data in _ranges(batches, ["value"]):
            numbers = _changes(data["value"].to_pylist())
            quotes, outside, inside = sums.get((file, start), (0, 0, 0))
            after, depth = _running(*numbers, quotes, outside)
            _, other = _running(*numbers, 1 - quotes, inside)
            sums[file, start] = int(after[-1]), int(depth[-1]), int(other[-1])
        rows = [(*place, *found) for place, found in sums.items()]
        yield pa.RecordBatch.from_pydict(
            {name: [row[i] for row in rows] for i, name in enumerate(("file", "start", "quotes", "outside", "inside"))},
            schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())]),
        )

    return pieces.mapInArrow(run, "file string, start long, quotes long, outside long, inside long")


def _range_states(pieces: DataFrame) -> DataFrame:
    """Per byte range the string state and depth at its start; one short row for each range."""
    in_order = Window.partitionBy("file").orderBy("start")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    states = _range_sums(pieces).withColumn("string", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).cast("long"))
    states = states.withColumn("change", F.when(F.col("string") == 1, F.col("inside")).otherwise(F.col("outside")))
    # The text after the last brace of a page is taken to end in one as well.
    sound = (F.sum("change").over(whole) == -1) & (F.sum("quotes").over(whole) % 2 == 0)
    return states.select(
        "file", "start", "string", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"), sound.alias("sound")
    )


def _elements(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Elements as text. `ends` is null for those that lie within a range.

    The first element to end in a range may have begun in an earlier one (ends),
    the text after the last may end in a later one (not ends).
    """

    def run(batches):
        place, kept, first = None, [], True
        for file, start, data in _ranges(batches, ("value", "string", "depth", "sound")):
            rows = []
            if place != (file, start):
                if kept:
                    rows.append((*place, False, "".join(kept)))
                if data["string"].null_count or not data["sound"][0].as_py():
                    raise ValueError(f"malformed page {file}: brackets or quotes do not match")
                place, kept, first = (file, start), [], True
                string, depth = data["string"][0].as_py(), data["depth"][0].as_py()
            texts, at = data["value"].to_pylist(), 0
            after, depths = _running(*_changes(texts), string, depth)
            string, depth = int(after[-1]), int(depths[-1])
            for close in np.flatnonzero((after == 0) & (depths == 1)).tolist():
                kept += [text + "}" for text in texts[at : close + 1]]
                rows.append((file, start, True if first else None, "".join(kept)))
                kept, at, first = [], close + 1, False
            kept += [text + "}" for text in texts[at:]]
            yield _element_batch(rows)
        if kept:
            yield _element_batch([(*place, False, "".join(kept))])

    # One short row per byte range.
    marked = pieces.join(F.broadcast(states), ["file", "start"], "left")
    return marked.select("file", "start", "value", "string", "depth", "sound").mapInArrow(
        run, "file string, start long, ends boolean, text string"
    )


def _element_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "start": pa.int64(), "ends": pa.bool_(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _joined(parts: DataFrame) -> DataFrame:
    """Elements that span ranges: each range has at most two parts, so a page has few."""
    in_order = Window.partitionBy("file").orderBy("start", F.desc("ends"))
    earlier = F.sum(F.col("ends").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = parts.withColumn("element", F.coalesce(earlier, F.lit(0)))
    whole = numbered.groupBy("file", "element").agg(
        F.array_sort(F.collect_list(F.struct("start", F.col("ends").cast("int").alias("ends"), "text"))).alias("parts")
    )
    text = whole.select(F.array_join(F.transform("parts", lambda part: part["text"]), "").alias("text"))
    # What follows the last element is the end of the array, and the brace every piece is given.
    return text.where(~F.col("text").rlike(r"\A\s*\[?\s*\]\s*\}\z"))


def read_ranges(spark: SparkSession, paths: str | list[str], schema=BRONZE_SCHEMA) -> DataFrame:
    """read_pages by byte ranges: parallel within a page.

    The text is scanned three times, for the states, for the elements within a
    range and for those across ranges; nothing is written.
    """
    pieces = _pieces(spark, paths)
    found = _elements(pieces, _range_states(pieces))
    texts = found.where(F.col("ends").isNull()).select("text").unionByName(_joined(found.where(F.col("ends").isNotNull())))
    begins = r"\A\s*[\[,]\s*(?=\{)"
    element = F.when(F.col("text").rlike(begins), F.regexp_replace("text", begins, "")).otherwise(
        F.raise_error(F.concat(F.lit("malformed page: "), F.substring("text", 1, 80)))
    )
    return texts.select(F.from_json(element, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def read_pages(
    spark: SparkSession, folder: str, files: str = PAGE_FILES, schema=BRONZE_SCHEMA, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """All pages of a folder, one row per array element, every value as text.

    The schema is declared, so an absent key is NULL and no pass over the data
    is spent on inference. A damaged page stops the read instead of turning
    into a row of NULLs. Pages of at most whole_bytes are read by one task each,
    larger ones in byte ranges; the rows are the same.
    """
    try:
        listed = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{files}").select("path", "length")
        sizes = {row["path"]: row["length"] for row in listed.collect()}
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no {files} in {folder}") from problem
        raise
    large = sorted(path for path, size in sizes.items() if size > whole_bytes)
    small = sorted(set(sizes).difference(large))
    read = []
    if small or not large:
        reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
        read.append(reader.json(small or f"{folder.rstrip('/')}/{files}"))
    if large:
        read.append(read_ranges(spark, large, schema))
    return read[0] if len(read) == 1 else read[0].unionByName(read[1])


def bronze_scan(spark: SparkSession, folder: str, files: str = PAGE_FILES) -> DataFrame:
    """read_pages, refusing a folder whose pages are all empty."""
    rows = read_pages(spark, folder, files)
    if rows.isEmpty():
        raise ValueError(f"every page in {folder} is empty")
    return rows


def write_pages(
    rows: DataFrame, folder: str, page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES, compression: str = "none"
) -> str:
    """Write rows as page files and return the file pattern that reads them back.

    Each task writes its rows one by one and begins a new page when the next row
    would take it over page_rows or page_bytes, so no value holds more than a row.
    Every row repeats the names of its fields, so compressed pages are several times smaller; page_bytes is
    meant before compression.
    """
    lines = rows.select(F.to_json(F.struct(*[F.col(name) for name in rows.columns])).alias("value"))

    def run(batches):
        part, page, count, size, line, waiting = TaskContext.get().partitionId(), -1, page_rows, 0, 0, None
        for batch in batches:
            made = []
            for text in batch.column("value").to_pylist():
                length = len(text.encode()) + 2
                fresh = count >= page_rows or size + length > page_bytes
                if waiting is not None:
                    made.append((*waiting[:2], waiting[2] + ("]" if fresh else "")))
                if fresh:
                    page, count, size = page + 1, 0, 0
                waiting = (f"{part:06d}-{page:06d}", line, ("[" if fresh else ",") + text)
                count, size, line = count + 1, size + length, line + 1
            yield _line_batch(made)
        if waiting is not None:
            yield _line_batch([(*waiting[:2], waiting[2] + "]")])

    paged = lines.mapInArrow(run, "_page string, line long, value string").sortWithinPartitions("_page", "line")
    paged.select("_page", "value").write.mode("overwrite").option("compression", compression).partitionBy("_page").text(folder)
    return "_page=*/part-*"


def _line_batch(lines: list[tuple]) -> pa.RecordBatch:
    kinds = {"_page": pa.string(), "line": pa.int64(), "value": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in lines], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))
