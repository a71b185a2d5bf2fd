"""Exact duplicates by sorting contents: sampled splitters, external sort, neighbours compared in full.

Rows are dealt into ranges by (first code points, digest of the whole text,
doc_id) and sorted so within their range. Spark samples the splitters; its
sample holds these short keys, never whole texts, and is bounded (at most a
million keys). The digest keeps texts with a long common beginning apart, and
doc_id cuts a group of equal texts that is larger than a range, so no group
however large ends up in one task. Sorting spills to disk where it must.

In a sorted range equal texts are neighbours. One pass compares each text with
the one before it, in full, and numbers the stretches of equal ones. A stretch
at the edge of its range may go on in the next: for each range at most two
stretches, first and last, are compared with their neighbours afterwards, so
what is broadcast has at most two short rows per range.

Null text counts as empty. Of equal texts the row with the largest doc_id stays,
nulls being smallest; of several rows with that id exactly one stays. An empty
table gives an empty result; only doc_id and the text column are read, so
further columns cannot clash.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendergrid.llm import common

# Code points of a text that come before its digest in the order.
HEAD = 32
FIRST, LAST = 0, 1


def content_sorted(documents: DataFrame, text: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """doc_id, text and its digest, in ranges by content; equal texts lie next to each other, by doc_id."""
    rows = documents.select("doc_id", normalise(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    order = [F.substring("text", 1, HEAD), F.col("text_sha256"), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


class _Stretches:
    """Stretches of equal texts in one sorted range; keeps the ids of the open one only."""

    def __init__(self, schema: pa.Schema, part: int, keep_texts: bool):
        self.schema, self.part, self.keep_texts = schema, part, keep_texts
        self.open, self.digest, self.text, self.first = [], None, None, True

    def _made(self, ids, digests, keep, rows, last, edge=None, text=None):
        """Rows of finished stretches; text holds what to keep of those where last is true."""
        n = len(ids)
        columns = {
            "doc_id": ids, "text_sha256": digests, "keep_id": keep, "group_size": rows, "last": last,
            "part": pa.array(np.full(n, self.part, np.int32)),
            "edge": pa.array([edge], pa.int32()).take(pa.array(np.zeros(n, np.int64))),
            "text": pa.nulls(n, pa.string()) if text is None else text,
        }
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in self.schema], schema=self.schema)

    def _closed(self, edge=None):
        """The open stretch, whose number of rows is known now."""
        edge = FIRST if self.first else edge
        ids = pa.concat_arrays(self.open)
        n = len(ids)
        every = pa.array(np.zeros(n, np.int64))
        last = np.arange(n) == n - 1
        text = pa.array([self.text], pa.string()).take(pa.array(np.where(last, 0, None))) if edge is not None or self.keep_texts else None
        keep = ids.slice(n - 1).take(every)
        made = self._made(ids, pa.array([self.digest]).take(every), keep, pa.array(np.full(n, n)), pa.array(last), edge, text)
        self.open, self.first = [], False
        return made

    def add(self, batch: pa.RecordBatch):
        ids, texts, digests = (batch.column(name) for name in ("doc_id", "text", "text_sha256"))
        n = len(ids)
        if not n:
            return
        starts = np.flatnonzero(~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
        if self.open and texts[0].as_py() == self.text:
            self.open.append(ids.slice(0, starts[0] if len(starts) else n))
            if not len(starts):
                return
        else:
            starts = np.concatenate([[0], starts])
        if self.open:
            yield self._closed()
        if self.first and len(starts) > 1:
            self._begin(ids, texts, digests, starts[0], starts[1])
            yield self._closed()
            starts = starts[1:]
        if len(starts) > 1:
            yield self._inner(ids, texts, digests, starts[:-1], starts[1:])
        self._begin(ids, texts, digests, starts[-1], n)

    def _begin(self, ids, texts, digests, start, end):
        self.open = [ids.slice(start, end - start)]
        self.digest, self.text = digests[int(start)].as_py(), texts[int(start)].as_py()

    def _inner(self, ids, texts, digests, starts, ends):
        """Stretches that begin and end within a batch."""
        sizes = ends - starts
        low, high = int(starts[0]), int(ends[-1])
        at = pa.array(np.repeat(ends - 1, sizes))
        last = np.arange(low, high) == np.repeat(ends - 1, sizes)
        text = texts.take(pa.array(np.where(last, np.arange(low, high), None), pa.int64())) if self.keep_texts else None
        cut = [column.slice(low, high - low) for column in (ids, digests)]
        return self._made(*cut, ids.take(at), pa.array(np.repeat(sizes, sizes)), pa.array(last), None, text)

    def finish(self):
        if self.open:
            yield self._closed(LAST)


def _stretches(ordered: DataFrame, keep_texts: bool) -> DataFrame:
    """Per row the stretch it is in: its size, last id, and for stretches at an edge of the range which edge."""
    id_type = ordered.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("keep_id", id_type),
            T.StructField("group_size", T.LongType()),
            T.StructField("last", T.BooleanType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("edge", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches):
        work = None
        for batch in batches:
            if work is None:
                kinds = {"doc_id": batch.schema.field("doc_id").type, "text_sha256": pa.string(), "group_size": pa.int64(),
                         "last": pa.bool_(), "part": pa.int32(), "edge": pa.int32(), "text": pa.string()}
                kinds["keep_id"] = kinds["doc_id"]
                arrow = pa.schema([(f.name, kinds[f.name]) for f in schema.fields])
                work = _Stretches(arrow, TaskContext.get().partitionId(), keep_texts)
            yield from work.add(batch)
        if work is not None:
            yield from work.finish()

    return ordered.mapInArrow(run, schema)


def _joined_edges(stretches: DataFrame) -> DataFrame:
    """Per range and edge: size and last id of the whole group, and whether the group ends there.

    The stretch that ends a range and the one that begins the next non-empty
    range are one group if their texts are equal; a group may span many ranges.
    """
    edges = stretches.where(F.col("edge").isNotNull() & F.col("last"))
    in_order = Window.orderBy("part", "edge")
    # At most two rows per range, without their texts.
    places = edges.select(
        "part", "edge", F.col("keep_id").alias("last_id"), F.col("group_size").alias("n"),
        F.lag("part").over(in_order).alias("before_part"), F.lag("edge").over(in_order).alias("before_edge"),
    )
    before = edges.select(F.col("part").alias("before_part"), F.col("edge").alias("before_edge"), F.col("text").alias("before_text"))
    after = edges.where(F.col("edge") == FIRST).select("part", "edge", "text")
    linked = (
        places.join(before, ["before_part", "before_edge"])
        .join(after, ["part", "edge"])
        .where(F.col("text") == F.col("before_text"))
        .select("part", "edge", F.lit(0).alias("begins"))
    )
    chain = F.sum(F.coalesce("begins", F.lit(1))).over(in_order)
    chained = places.join(linked, ["part", "edge"], "left").select("part", "edge", "last_id", "n", chain.alias("chain"))
    whole = Window.partitionBy("chain").orderBy("part", "edge").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = Window.partitionBy("chain").orderBy("part", "edge")
    return chained.select(
        "part", "edge",
        F.sum("n").over(whole).alias("whole_size"),
        F.last("last_id").over(whole).alias("whole_id"),
        F.lead("part").over(ahead).isNull().alias("ends"),
    )


def _decided(documents: DataFrame, text: str, normalise, keep_texts: bool) -> DataFrame:
    found = common.staged(_stretches(content_sorted(documents, text, normalise), keep_texts), "content-sort")
    # At most two rows per range of the sort, whatever the number of documents.
    edges = F.broadcast(_joined_edges(found))
    at_edge = F.col("edge").isNotNull()
    return found.join(edges, ["part", "edge"], "left").select(
        "doc_id",
        F.when(at_edge, F.col("whole_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(at_edge, F.col("whole_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("last") & F.coalesce("ends", F.lit(True))).alias("kept"),
        "text_sha256", "text",
    )


def classify(documents: DataFrame, text: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return _decided(documents, text, normalise, False).drop("text")


def deduplicated(documents: DataFrame, text: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """doc_id and normalised text of the rows that stay."""
    return _decided(documents, text, normalise, True).where("kept").select("doc_id", F.col("text").alias(text))
