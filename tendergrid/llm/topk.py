"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into SLICES lists; each list gives a part of a score.
Phase 1: every block of vectors gathers, for one list each (in turn), the local
best entries and scores them in full. The k-th best gathered score of a query is
a safe lower bound of what it must reach, its cutoff. Phase 2: the cutoffs are
broadcast with the queries. A query leaves out a block in which no list can give
cutoff / SLICES by the norms of query and vectors (if every part stays below
that, the whole does). In the blocks left, list after list is added; an entry
goes as soon as what it has and the most that its remaining lists can add (again
by norms) is below the cutoff. Phase 3: entries that outlast all lists carry
their exact score; each task keeps the best k per query, whose k-th in turn
raises the cutoff for the blocks to come.

Vectors stay where they lie and are never shuffled: queries are broadcast in
groups of at most GROUP rows and GROUP_BYTES, one pass over the vectors a group,
and only the local lists are shuffled. A task holds one block of vectors, one
group of queries and k entries a query; entries that tie at the k-th place are
ordered by id before they are cut.

Components become floor(256 * x). Sums are exact: as doubles while the norms
show that they fit 53 bits, as 64-bit numbers up to 2^62, as whole numbers of
any size beyond. A score among the best that does not fit 64 bits is an error,
and so is a component of 2^55 or more. Vectors that are null, empty or hold
null, non-finite components take no part; vectors of different length are
compared over the components both have. Ties go to the smaller vec_id. Rows that
repeat a vec_id are rows of their own: each is a query, and a candidate of the
others. Rows with a null vec_id take no part. Only vec_id and the vector are
read, so further columns cannot clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendergrid.llm import common

K = 5
EVERY = 50
SLICES = 4
BLOCK = 1024
GROUP, GROUP_BYTES = 2048, 32 << 20
LOWEST = -(1 << 63)

_MET = "query_row long, query_id long, vec_id long, score long"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector as whole numbers, for vectors that take part."""
    v = F.col(column)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    large = F.raise_error(F.lit("a component of 2^55 or more has no 64-bit value")).cast("bigint")
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < 2.0**55, F.floor(x.cast("double") * 256).cast("bigint")).otherwise(large))
    return vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def numbered(rows: DataFrame, purpose: str) -> DataFrame:
    """Staged rows with a number of their own."""
    return common.staged(rows.withColumn("row", F.monotonically_increasing_id()), purpose)


class Block:
    """Vectors of equal width (shorter ones filled with zeros), their norms by list and their size class."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, lists: pa.Array, slices: int):
        self.rows, self.ids = rows, ids
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        wide = int(lengths.max(initial=0))
        self.v = np.zeros((len(lengths), wide), np.int64)
        self.v[np.arange(wide) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        self._measure(slices)

    def _measure(self, slices: int) -> None:
        # Rounded up, so that bounds made from norms are never too small.
        real = self.v.astype(np.float64)
        self.cuts = np.linspace(0, self.v.shape[1], slices + 1).astype(int)
        parts = [np.sqrt((real[:, a:b] ** 2).sum(1)) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.norms = np.stack(parts, 1) * (1 + 1e-9) if parts else np.zeros((len(real), 0))
        norm = np.sqrt((self.norms**2).sum(1))
        self.size = np.where(norm < 2.0**26, 0, np.where(norm < 2.0**31, 1, 2))

    def widened(self, wide: int, slices: int) -> "Block":
        """The same vectors with `wide` components, so that lists of two blocks are the same dimensions."""
        if wide != self.v.shape[1]:
            v = np.zeros((len(self.v), wide), np.int64)
            v[:, : min(wide, self.v.shape[1])] = self.v[:, :wide]
            self.v = v
            self._measure(slices)
        return self


def products(q: np.ndarray, v: np.ndarray, q_size: np.ndarray, v_size: np.ndarray) -> np.ndarray:
    """Exact inner products, cut to 64 bits; sizes say in which arithmetic they fit."""
    if max(q_size.max(initial=0), v_size.max(initial=0)) == 0:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if max(q_size.max(initial=0), v_size.max(initial=0)) == 1:
        return q @ v.T
    out = np.empty((len(q), len(v)), np.int64)
    most = (1 << 63) - 1
    for q_rows, v_rows in ((q_size < 2, v_size < 2), (q_size == 2, v_size >= 0), (q_size < 2, v_size == 2)):
        if not q_rows.any() or not v_rows.any():
            continue
        if q_size[q_rows].max() < 2 and v_size[v_rows].max() < 2:
            found = products(q[q_rows], v[v_rows], q_size[q_rows], v_size[v_rows])
        else:
            whole = q[q_rows].astype(object) @ v[v_rows].T.astype(object)
            found = np.array([[min(max(x, LOWEST), most) for x in line] for line in whole], np.int64)
        out[np.ix_(q_rows, v_rows)] = found
    return out


class Best:
    """The best k entries of each query so far: score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.query = np.empty(0, np.int64)
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.kth = np.full(queries, LOWEST)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(pair) for pair in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score.astype(np.float64), query)) if len(score) and abs(score).max() < 1 << 52 else _exact_order(query, score, ids)
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        self.query, self.score, self.id = (values[rank < self.k] for values in (query, score, ids))
        full = query[rank == self.k - 1]
        self.kth[full] = score[rank == self.k - 1]


def _exact_order(query, score, ids):
    # ~score falls as score rises, without leaving 64 bits.
    return np.lexsort((ids, ~score, query))


def gather(q: Block, v: Block, slices: int, turn: int, best: Best) -> None:
    """Phase 1: the local best of one list, scored in full."""
    part = turn % slices
    a, b = q.cuts[part], q.cuts[part + 1]
    k = min(best.k + 1, len(v.ids))
    if not k or not len(q.ids):
        return
    partial = q.v[:, a:b].astype(np.float64) @ v.v[:, a:b].T.astype(np.float64)
    chosen = np.argpartition(-partial, k - 1, axis=1)[:, :k]
    query = np.repeat(np.arange(len(q.ids)), k)
    entry = chosen.ravel()
    other = q.rows[query] != v.rows[entry]
    query, entry = query[other], entry[other]
    if max(q.size.max(initial=0), v.size.max(initial=0)) < 2:
        score = np.einsum("ij,ij->i", q.v[query], v.v[entry])
        best.add(query, score, v.ids[entry])


def collect(q: Block, v: Block, slices: int, cutoff: np.ndarray, best: Best) -> np.ndarray:
    """Phases 2 and 3 for one block; returns how many entries were left out after 0, 1, ... lists."""
    skipped = np.zeros(slices + 1, np.int64)
    least = np.maximum(cutoff, best.kth)
    cutoff = least.astype(np.float64)
    # No list of the block can give a query its share of the cutoff: the query leaves the block out.
    share = np.where(cutoff > 0, cutoff / slices * (1 - 1e-9), -np.inf)
    live = (q.norms * v.norms.max(0, initial=0) >= share[:, None]).any(1)
    skipped[0] = (~live).sum() * len(v.ids)
    rows = np.flatnonzero(live)
    columns = np.arange(len(v.ids))
    if max(q.size[rows].max(initial=0), v.size.max(initial=0)) < 2:
        score = np.zeros((len(rows), len(columns)), np.int64)
        for part in range(slices):
            if not len(rows) or not len(columns):
                break
            a, b = q.cuts[part], q.cuts[part + 1]
            score += products(q.v[rows, a:b], v.v[columns, a:b], q.size[rows], v.size[columns])
            if part + 1 < slices:
                rest = q.norms[rows, part + 1 :] @ v.norms[columns, part + 1 :].T * (1 + 1e-9)
                bound = score + rest
                alive = bound + np.abs(bound) * 1e-9 + 1 >= cutoff[rows, None]  # rounded towards keeping
                keep_rows, keep_columns = alive.any(1), alive.any(0)
                before = alive.size
                if not keep_rows.all() or not keep_columns.all():
                    rows, columns = rows[keep_rows], columns[keep_columns]
                    score = score[np.ix_(keep_rows, keep_columns)]
                skipped[part + 1] = before - score.size
    else:
        score = products(q.v[rows], v.v, q.size[rows], v.size)
    if score.size:
        limit = least[rows]
        if score.shape[1] > best.k:
            limit = np.maximum(limit, np.partition(score, score.shape[1] - best.k - 1, axis=1)[:, score.shape[1] - best.k - 1])
        chosen = (score >= limit[:, None]) & (q.rows[rows][:, None] != v.rows[columns][None, :])
        at, entry = np.nonzero(chosen)
        best.add(rows[at], score[at, entry], v.ids[columns[entry]])
    return skipped


def _blocks(batches, slices: int, block: int):
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            yield Block(part.column("row").to_numpy(), part.column("vec_id").to_numpy(), part.column("v"), slices)


def _groups(queries: DataFrame, group: int):
    """Queries in groups of bounded size, one group on the driver at a time."""
    held, size = [], 0
    for row in queries.toLocalIterator(prefetchPartitions=True):
        if held and (len(held) >= group or size + 8 * len(row.v) > GROUP_BYTES):
            yield held
            held, size = [], 0
        held.append(row)
        size += 8 * len(row.v)
    if held:
        yield held


def _pass(vectors: DataFrame, queries: list, cutoffs: np.ndarray | None, k: int, slices: int, block: int) -> DataFrame:
    """One pass over the vectors: gathered lists (no cutoffs yet) or what passes the cutoffs."""
    rows, ids = np.array([r.row for r in queries]), np.array([r.vec_id for r in queries])
    lists = [list(r.v) for r in queries]
    shared = vectors.sparkSession.sparkContext.broadcast((rows, ids, lists, cutoffs))

    def run(batches):
        rows, ids, lists, cutoffs = shared.value
        q = Block(rows, ids, pa.array(lists, pa.list_(pa.int64())), slices)
        best = Best(len(ids), k)
        for turn, v in enumerate(_blocks(batches, slices, block)):
            wide = max(q.v.shape[1], v.v.shape[1])
            q, v = q.widened(wide, slices), v.widened(wide, slices)
            if cutoffs is None:
                gather(q, v, slices, turn, best)
            else:
                collect(q, v, slices, cutoffs, best)
        yield pa.RecordBatch.from_pydict(
            {"query_row": q.rows[best.query], "query_id": q.ids[best.query], "vec_id": best.id, "score": best.score},
            schema=pa.schema([(n, pa.int64()) for n in ("query_row", "query_id", "vec_id", "score")]),
        )

    return vectors.select("row", "vec_id", "v").mapInArrow(run, _MET)


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cutoffs(gathered: DataFrame, queries: list, k: int) -> np.ndarray:
    """The k-th best of what was gathered for each query of a group; queries with fewer gathered take all."""
    found = _ranked(gathered, k).where(F.col("rank") == k).select("query_row", "score").collect()
    at = {r.query_row: r.score for r in found}
    return np.array([at.get(r.row, LOWEST) for r in queries], np.int64)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = K, slices: int = SLICES, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_row, query_id, rank, vec_id, score of each query's best k.

    Both sides have vec_id, v (see usable) and row; a vector with the row of a query is the query itself.
    """
    schema = "query_row long, query_id long, rank int, vec_id long, score long"
    results = []
    for held in _groups(queries.select("row", "vec_id", "v").orderBy("row"), group):
        cutoffs = _cutoffs(_pass(vectors, held, None, k, slices, block), held, k)
        met = _pass(vectors, held, cutoffs, k, slices, block)
        results.append(common.staged(_ranked(met, k), "topk-group"))
    if not results:
        return queries.sparkSession.createDataFrame([], schema)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    misfit = F.raise_error(F.lit("a score does not fit 64 bits")).cast("bigint")
    score = F.when((F.col("score") == LOWEST) | (F.col("score") == (1 << 63) - 1), misfit).otherwise(F.col("score"))
    return found.select("query_row", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def search(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`, candidates all rows but the query's own."""
    rows = numbered(usable(embeddings), "topk-vectors")
    return nearest(rows.where(F.col("vec_id") % every == 0), rows, k).drop("query_row")
