"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles (lower case, without marks), each
labelled with its occurrence, so that no label comes twice in a text. Every
sketch takes the KEPT labels of smallest hash and retains their text order.
Texts that agree in a sketch meet in its bucket; a pair is a link if the longest
common subsequence L of their labelled shingles, aligned within the band that
the threshold leaves, gives L / (n + m - L) >= SIMILARITY.

One pass compares the texts of a bucket with one leader, drawn by a hash salted
with the bucket, so that a text meets another leader in each of its buckets; it
joins large groups cheaply. Then every bucket that holds more than one class is
compared in full: each two of its texts that are of different classes are aligned
unless sizes or shared labels rule a link out, or classes have met meanwhile. A
bucket is cut into salted blocks, and a task holds two blocks at a time; the
largest class of a bucket is not compared with itself. A bucket of very many
blocks is parted first: two texts that are a link share one of the rarest fifth
of their labels, so each such label makes a smaller bucket. So texts that share
a bucket lose no link. Classes are connected components
of the links, found by alternating large and small stars. Links, classes and pairs stay distributed.

Rows of equal text are one entry from the start, so a group of copies costs one
row per copy. Null text counts as empty; equal texts are always one class, and
texts without words are in no other. Texts of under five words have one shingle of all
their words. class_id is the smallest doc_id of the class (null only if all are null). Repeated rows and
ties need no order. An empty table gives an empty result.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendergrid.llm import common
from tendergrid.operators import skew

SHINGLE = 5
SKETCHES = 16
KEPT = 4
SIMILARITY = 0.8
# A block of a bucket holds about so many texts, and about so many labels, at most.
BLOCK_ROWS = 500
BLOCK_LABELS = 1_000_000
# A bucket of more blocks than this is first parted by rare labels. Comparing block by block sends a
# text along once per block, 8 bytes a word; parting it sends about three rows of 60 bytes a label.
MOST_BLOCKS = 24
# Rows of one text that a task gets at most, or 1e-4 of all rows if those are more.
COPIES = 1_000
# Shingles above which sketches are made one after another, to bound memory.
LONG = 50_000

_SPACES, _MARKS = "\t\n\x0b\f\r ", ".,;:!?\"'()"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(4_096).integers(1, 1 << 63, SKETCHES, np.uint64)
_PLACES = np.random.default_rng(4_097).integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)


def words_of(text: str) -> str:
    """SQL: hashes of a text's words, in order."""
    spaced = f"translate(lower({text}), '{_SPACES}{_MARKS.replace(chr(39), chr(92) + chr(39))}', '{' ' * len(_SPACES)}')"
    return f"transform(array_remove(split({spaced}, ' ', -1), ''), w -> xxhash64(w))"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def labelled(words: np.ndarray) -> np.ndarray:
    """Shingle hashes in text order, each mixed with its occurrence."""
    words = words.astype(np.int64).view(np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    hashes = np.zeros(count, np.uint64)
    for i in range(size):
        hashes += words[i : i + count] * _PLACES[i]
    hashes = _mixed(hashes * _ODD)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not first.all():
        starts = np.flatnonzero(first)
        occurrence = np.arange(count) - np.repeat(starts, np.diff(np.append(starts, count)))
        hashes[order] = ranked + occurrence.astype(np.uint64) * _ODD
    return hashes


def sketch(labels: np.ndarray) -> list[int]:
    """One number per sketch: the kept labels in text order, and the sketch's number."""
    out = []
    kept = min(KEPT, len(labels))
    step = SKETCHES if len(labels) <= LONG else 1
    for at in range(0, SKETCHES, step):
        seeds = _SEEDS[at : at + step, None]
        values = _mixed((labels[None, :] ^ seeds) * _ODD)
        places = np.sort(np.argpartition(values, kept - 1, axis=1)[:, :kept], axis=1)
        number = seeds[:, 0].copy()
        for j in range(kept):
            number = _mixed((number ^ labels[places[:, j]]) * _ODD)
        out += number.view(np.int64).tolist()
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned likeness of two labelled sequences if it is at least `least`, else 0."""
    total = len(a) + len(b)
    need = max(int(np.ceil(least / (1 + least) * total - 1e-9)), 1)
    if min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= max(len(a), len(b)) - need  # outside this band too little is left to match
    i, j = i[inside], j[inside]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        longest = len(j)
    else:
        from bisect import bisect_left

        ends: list[int] = []
        for place in j.tolist():
            at = bisect_left(ends, place)
            ends[at : at + 1] = [place]
        longest = len(ends)
    return longest / (total - longest) if longest >= need else 0.0


def _sketched(rows: DataFrame) -> DataFrame:
    """key, n (shingles) and sketches of every row with words."""

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            keys, counts, made = [], [], []
            for key, a, b in zip(batch.column("key").to_pylist(), ends[:-1], ends[1:], strict=True):
                if a < b:
                    labels = labelled(flat[a:b])
                    keys.append(key)
                    counts.append(len(labels))
                    made.append(sketch(labels))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(counts, pa.int32()), pa.array(made, pa.list_(pa.int64()))],
                ["key", "n", "sketches"],
            )

    words = rows.select("key", F.expr(words_of("text")).alias("words"))
    return words.mapInArrow(run, "key string, n int, sketches array<bigint>")


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(labelled(np.asarray(x)), labelled(np.asarray(y))) for x, y in zip(a, b, strict=True)], dtype=float)


def _key(text: str = "text"):
    return F.md5(F.encode(common.text_or_empty(text), "UTF-8"))


def components(links: DataFrame) -> DataFrame:
    """key and class (its smallest key) of every key in links (a, b)."""
    edges = common.staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        # Done when the links are stars: a node points to one centre, and no centre points on.
        tops = edges.select(F.col("v").alias("u"), F.lit(1).alias("centre"), F.lit(0).alias("points"))
        roles = tops.unionByName(edges.select("u", F.lit(0).alias("centre"), F.lit(1).alias("points")))
        if roles.groupBy("u").agg(F.max("centre").alias("c"), F.sum("points").alias("p")).where("c + p > 1").isEmpty():
            break
        # Large star: every larger neighbour of a node points to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.staged(large.where("u != v"), "large-star")
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges = common.staged(small.where("u != v").distinct(), "small-star")
    tops = edges.select(F.col("v").alias("key")).distinct().withColumn("class", F.col("key"))
    return edges.select(F.col("u").alias("key"), F.col("v").alias("class")).unionByName(tops)


def _merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes of keys after links (a, b) between classes."""
    joined = components(links)
    if classes is None:
        return joined
    joined = common.staged(joined, "joined-classes")
    above = joined.select(F.col("key").alias("class"), F.col("class").alias("_above"))
    old = classes.join(above, "class", "left").select("key", F.coalesce("_above", "class").alias("class"))
    return common.staged(old.unionByName(joined.join(classes, "key", "left_anti")), "merged-classes")


def _with_class(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    rows = rows.drop("class")
    if classes is None:
        return rows.withColumn("class", F.col("key"))
    return rows.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))


def _texts(documents: DataFrame, per_key: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and text, once for each wanted key; texts are dealt out by doc_id, not by copies."""
    chosen = per_key.join(wanted, "key", "left_semi").select("none", "id", "key")
    rows = documents.select(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), common.text_or_empty().alias("text"))
    met = rows.withColumn("key", _key()).join(chosen, ["none", "id", "key"])
    return met.dropDuplicates(["none", "id", "key"]).select("key", "text")


def _block_links(labels: list[np.ndarray], classes: list[str], second: np.ndarray) -> list[tuple[str, str]]:
    """Links that join classes: rows of the first block against those of the second, or all rows if there is none."""
    parent = {c: c for c in classes}

    def top(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    order = np.argsort([len(x) for x in labels], kind="stable")
    labels, classes, second = [labels[i] for i in order], [classes[i] for i in order], second[order]
    sizes = np.array([len(x) for x in labels])
    apart = second.any()
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if apart else left
    _, flat = np.unique(np.concatenate(labels), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = [flat[ends[i] : ends[i + 1]] for i in range(len(labels))]
    others = np.concatenate([own[i] for i in right])
    starts = np.concatenate([[0], np.cumsum(sizes[right])])
    seen = np.zeros(int(flat.max()) + 1, bool)
    out = []
    for at, i in enumerate(left):
        # Sizes rise, so the rows whose size lets them link lie together.
        a = np.searchsorted(sizes[right], np.ceil(sizes[i] * SIMILARITY - 1e-9)) if apart else at + 1
        b = np.searchsorted(sizes[right], np.floor(sizes[i] / SIMILARITY + 1e-9), "right")
        if a >= b:
            continue
        seen[own[i]] = True
        shared = np.add.reduceat(seen[others[starts[a] : starts[b]]], starts[a:b] - starts[a], dtype=np.int64)
        seen[own[i]] = False
        need = SIMILARITY / (1 + SIMILARITY) * (sizes[i] + sizes[right[a:b]]) - 1e-9
        for j in right[a:b][shared >= need]:
            mine, its = top(classes[i]), top(classes[j])
            if mine != its and similarity(labels[i], labels[j]) > 0:
                parent[mine] = its
                out.append((classes[i], classes[j]))
    return out


def _blocks(c, n):
    return F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(n / BLOCK_LABELS)).cast("int")


def _parted(state: DataFrame, texts: DataFrame) -> DataFrame:
    """State with the buckets of more than MOST_BLOCKS parted by their texts' rarest labels.

    Labels of a bucket are ordered by their count in it. A link of n and m labels has SIMILARITY * n
    of the n in common at least, so that both hold one among the n - SIMILARITY * n + 1 first of
    either: the parts lose no link of the bucket, and a label that most texts share makes no part
    unless a text has too few others.
    """
    sizes = state.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("n").alias("m"), F.min("class").alias("_a"), F.max("class").alias("_z"))
    crowded = common.staged(sizes.where((_blocks(F.col("c"), F.col("m")) > MOST_BLOCKS) & (F.col("_a") < F.col("_z"))).select("bucket"), "crowded")
    if crowded.isEmpty():
        return state

    def run(batches):
        for batch in batches:
            for key, words in zip(batch.column("key").to_pylist(), batch.column("words"), strict=True):
                labels = pa.array(labelled(words.values.to_numpy()).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(labels), pa.string()), labels], ["key", "label"])

    rows = state.join(crowded, "bucket", "left_semi")
    words = texts.join(rows.select("key").distinct(), "key", "left_semi").select("key", F.expr(words_of("text")).alias("words"))
    labels = rows.join(words.mapInArrow(run, "key string, label bigint"), "key").withColumn("part", F.xxhash64("bucket", "label"))
    labels = common.staged(labels.select("key", "n", "class", "bucket", "part"), "bucket-labels")
    counted = labels.groupBy("part").agg(F.count("*").alias("held"))
    ranked = skew.attach_key_figures(labels, counted, "part", "held", "key", hot_rows=COPIES)
    rank = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("held", "part"))
    first = ranked.withColumn("_rank", rank).where(F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1)
    # A label held by one text alone brings it together with none.
    parts = first.where("held > 1").select("key", "n", F.col("part").alias("bucket"), "class").distinct()
    return common.staged(state.join(crowded, "bucket", "left_anti").select(*parts.columns).unionByName(parts), "parted")


def _in_full(state: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of every bucket of state (key, n, bucket, class), all of its pairs compared."""
    state = _parted(state, texts)
    held = state.groupBy("bucket", "class").agg(
        F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("x")
    )
    plan = held.groupBy("bucket").agg(
        F.count("*").alias("classes"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("h").alias("h"), F.bit_xor("x").alias("x"),
        F.max(F.struct("n", "c", "class")).alias("most"),
    ).where("classes > 1")
    # Buckets of the same texts are one.
    plan = plan.groupBy("c", "n", "h", "x", "most").agg(F.min("bucket").alias("bucket"))

    plan = plan.withColumn("all", _blocks(F.col("c"), F.col("n"))).select(
        "bucket", F.col("most.class").alias("main"),
        F.when(F.col("all") == 1, 1).otherwise(_blocks(F.col("c") - F.col("most.c"), F.col("n") - F.col("most.n"))).alias("rest"),
        F.when(F.col("all") == 1, 0).otherwise(_blocks(F.col("most.c"), F.col("most.n"))).alias("mains"),
    )
    rows = state.join(common.staged(plan, "bucket-plan"), "bucket")
    salt = F.xxhash64(F.lit(2), "key", "bucket")
    is_main = (F.col("class") == F.col("main")) & (F.col("mains") > 0)
    block = F.when(is_main, F.col("rest") + F.pmod(salt, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(salt, F.col("rest"))).cast("int")
    rows = rows.withColumn("block", block).withColumn("till", F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")))
    words = texts.select("key", F.expr(words_of("text")).alias("words"))
    met = rows.select("key", "bucket", "class", "block", "till").join(words, "key")
    met = met.withColumn("other", F.explode(F.expr("sequence(0, till - 1)"))).select(
        "bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "class", "words"
    )
    dealt = met.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def run(batches):
        group, labels, classes, second = None, [], [], []

        def ended():
            links = _block_links(labels, classes, np.array(second)) if len(set(classes)) > 1 and (group[1] == group[2] or 0 < sum(second) < len(second)) else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.string()), pa.array([y for _, y in links], pa.string())], ["a", "b"])

        for batch in batches:
            lists = batch.column("words")
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            heads = zip(*(batch.column(c).to_pylist() for c in ("bucket", "p", "q", "block", "class")), strict=True)
            for (bucket, p, q, own, its), a, b in zip(heads, ends[:-1], ends[1:], strict=True):
                if (bucket, p, q) != group:
                    if labels:
                        yield ended()
                    group, labels, classes, second = (bucket, p, q), [], [], []
                labels.append(labelled(flat[a:b]))
                classes.append(its)
                second.append(p != q and own == q)
        if labels:
            yield ended()

    return dealt.mapInArrow(run, "a string, b string").distinct()


def classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: doc_id, key (of the text) and number of every row; of every key class_id, size and its first row's doc_id.

    The row of a key with the smallest doc_id is told by `none` (the id is null) and `id`.
    """
    with common.passing_tables(documents.sparkSession):
        return _classes(documents.select("doc_id", "text"))


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = documents.select("doc_id", _key().alias("key"), F.monotonically_increasing_id().alias("row"))
    keys = common.staged(rows, "near-keys", lasting=True)
    # One row per text from here on, however many copies it has.
    place = F.struct(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    per_key = keys.groupBy("key").agg(F.min(place).alias("_one"), F.min("doc_id").alias("first"), F.count("*").alias("size"))
    per_key = common.staged(per_key.select("key", "first", "size", "_one.none", "_one.id"), "near-texts-by-key")
    sketched = _sketched(documents.select(_key().alias("key"), common.text_or_empty().alias("text")))
    sketched = common.staged(sketched.groupBy("key").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches")), "sketches")
    # A sketch holds its own number, so that it names a bucket.
    rows = sketched.select("key", "n", F.explode("sketches").alias("bucket"))
    many = rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = common.staged(rows.join(many, "bucket", "left_semi"), "members")
    texts = common.staged(_texts(documents, per_key, members.select("key").distinct()), "near-texts")
    order = F.struct(F.xxhash64("key", "bucket"), "key", "n")
    leaders = members.groupBy("bucket").agg(F.min(order).alias("_l"))
    leaders = common.staged(leaders.select("bucket", F.col("_l.key").alias("leader"), F.col("_l.n").alias("leader_n")), "leaders")
    fits = F.least("n", "leader_n") >= F.greatest("n", "leader_n") * SIMILARITY - 1e-9
    pairs = members.join(leaders, "bucket").where((F.col("key") != F.col("leader")) & fits)
    pairs = pairs.select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    words = texts.select("key", F.expr(words_of("text")).alias("w"))
    compared = pairs.join(words.select(F.col("key").alias("b"), F.col("w").alias("wb")), "b").join(
        words.select(F.col("key").alias("a"), F.col("w").alias("wa")), "a"
    )
    linked = compared.select("a", "b", _likeness("wa", "wb").alias("s")).where("s > 0")
    found = None
    # Links with leaders first, then all that is left between the classes these give.
    for links in (lambda: linked.select("a", "b"), lambda: _in_full(_with_class(members, found), texts)):
        fresh = common.staged(links(), "links")
        if not fresh.isEmpty():
            found = _merged(found, fresh)
    figures = ["key", "class_id", "size", "none", "id"]
    if found is None:
        return keys, common.staged(per_key.withColumnRenamed("first", "class_id").select(*figures), "near-classes", lasting=True)
    joined = common.staged(_with_class(per_key, found), "joined")
    tops = joined.groupBy("class").agg(F.min("first").alias("class_id"), F.count("*").alias("_texts"))
    # A class may hold very many texts, as a text very many copies: both are joined in pieces.
    of_key = skew.attach_key_figures(joined, tops, "class", "_texts", "key", hot_rows=COPIES)
    return keys, common.staged(of_key.select(*figures), "near-classes", lasting=True)


def classify(documents: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    keys, of_key = classes(documents)
    met = skew.attach_key_figures(keys, of_key.select("key", "class_id", "size"), "key", "size", "row", hot_rows=COPIES)
    return met.select("doc_id", "class_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id; the columns of documents."""
    documents = documents.select(*common.DOCUMENT_COLUMNS)
    _, of_key = classes(documents)
    place = F.struct("none", "id", "key")
    one = of_key.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("key"))).agg(F.min(place).alias("_one"))
    one = one.select("_one.*")
    rows = documents.withColumn("none", F.isnull("doc_id")).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("key", _key())
    return rows.join(one, ["none", "id", "key"]).dropDuplicates(["none", "id", "key"]).select(*common.DOCUMENT_COLUMNS)
