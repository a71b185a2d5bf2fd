"""SimHash fingerprints of whole texts; DataFrame functions only.

Terms are pairs of neighbouring words (a lone word stands for itself), parted at
ASCII white space. Each term votes with its length, at most MOST_WEIGHT, on the
64 signed bits of its hash; a bit is set when the votes for it are the majority. The votes
for bits b and b + 32 share one 64-bit sum (a text is under 2^31 characters),
so a text is 33 sums, added up in the task that holds its words and never
shuffled per word.

Fingerprints within a Hamming radius are found through permuted block tables:
with radius + 2 blocks at least two blocks of any such pair agree, so one table
per pair of blocks, keyed by both, holds every pair sought. Equal fingerprints
are one entry there, crowded keys are parted by block tables over their other bits,
and no pair leaves the join twice.

Null text counts as empty; a text without words has the fingerprint of zeros.
Equal texts have equal fingerprints. Rows are told apart by their place, so
repeated rows and repeated ids keep one result each; ties in doc_id are ordered
by text, null ids count as smaller than any other. An empty table gives an
empty result.
"""

import math
from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendergrid.llm import common
from tendergrid.operators import skew

BITS = 64
MOST_WEIGHT = 24
# Rows of a run of neighbouring ids that one task orders, on average.
RUN_ROWS = 1000
# Runs there may be at most: their heads are broadcast, some MB at the bound.
MOST_RUNS = 50_000
RADIUS = 3
# Fingerprints of one key of a block table above which the key is parted further.
CROWDED = 256
# Rows of one fingerprint that a task gets their count for, at most.
HOT_ROWS = 1000

_SPACES = "\t\n\x0b\f\r"


def _terms(text: str) -> str:
    """SQL: array of term hashes with weights; neighbouring words, linear in the text."""
    words = f"filter(split(translate({text}, '{_SPACES}', '     '), ' ', -1), x -> x != '')"
    return f"""transform(array({words}), w -> IF(size(w) < 2, transform(w, x -> struct(xxhash64(x) AS h, length(x) AS n)),
        zip_with(w, slice(w, 2, size(w)), (x, y) -> IF(y IS NULL, NULL, struct(xxhash64(x, y) AS h, length(x) + length(y) AS n)))))[0]"""


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per key with `bits`, a bigint; keys tell rows apart.

    Where rows already lie together by (part of) the keys nothing is shuffled.
    """
    term = F.explode_outer(F.expr(_terms(text))).alias("_term")
    weight = F.least(F.col("_term.n"), F.lit(MOST_WEIGHT)).cast("bigint")
    votes = rows.select(*keys, term).select(*keys, F.col("_term.h").alias("_h"), F.coalesce(weight, F.lit(0)).alias("_n"))
    half = BITS // 2
    both = F.lit(1 | 1 << half).cast("bigint")
    sums = [
        F.sum(F.coalesce(F.shiftrightunsigned("_h", b).bitwiseAND(both) * F.col("_n"), F.lit(0))).alias(f"_v{b}")
        for b in range(half)
    ]
    voted = votes.groupBy(*keys).agg(F.sum("_n").alias("_all"), *sums)
    bits = F.lit(0).cast("bigint")
    low = F.lit((1 << half) - 1).cast("bigint")
    for b in range(half):
        for place, own in ((b, F.col(f"_v{b}").bitwiseAND(low)), (b + half, F.shiftrightunsigned(f"_v{b}", half))):
            mask = (1 << place) - (1 << BITS if place == BITS - 1 else 0)
            bits = bits.bitwiseOR(F.when(own * 2 > F.col("_all"), F.lit(mask).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return voted.select(*keys, bits.alias("bits"))


def likeness(a, b):
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)).cast("double") / BITS


def as_text(bits):
    return F.lpad(F.lower(F.hex(bits)), BITS // 4, "0")


def _tables(places: list[int], radius: int) -> list[int]:
    """Masks of every two of radius + 2 even blocks of some bits: fingerprints within the radius agree on at least one."""
    blocks = radius + 2
    cut = [places[len(places) * i // blocks : len(places) * (i + 1) // blocks] for i in range(blocks)]
    masks = [sum(1 << place for place in one + other) for one, other in combinations(cut, 2)]
    return [mask - (mask >> BITS - 1 << BITS) for mask in masks]


def within_radius(queries: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """bits of distinct query fingerprints, every other distinct fingerprint `near` within the radius, and `distance`.

    A pair that meets in several tables counts in the first of them. A key that
    more than CROWDED fingerprints share is parted by tables over its other bits.
    """
    first = _tables(list(range(BITS)), radius)
    second = [_tables([place for place in range(BITS) if not mask >> place & 1], radius) for mask in first]

    def numbers(masks):
        return F.array(*[F.lit(mask).cast("bigint") for mask in masks])

    coarse, fine = numbers(first), F.get(F.array(*map(numbers, second)), F.col("t"))

    def entries(side, name):
        marked = side.select(F.col("bits").alias(name)).distinct().select(name, F.posexplode(coarse).alias("t", "mask"))
        return marked.select(name, "t", F.col(name).bitwiseAND(F.col("mask")).alias("a"))

    crowded = entries(rows, "near").groupBy("t", "a").agg(F.count("*").alias("c")).where(F.col("c") > CROWDED)
    crowded = common.staged(crowded.select("t", "a", F.lit(True).alias("crowded")), "crowded-keys")

    def parted(side, name):
        met = entries(side, name).join(crowded, ["t", "a"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        masks = F.when(F.col("crowded"), fine).otherwise(numbers([0]))
        met = met.select(name, "t", "a", "crowded", F.posexplode(masks).alias("s", "mask"))
        return met.select(name, "t", "a", "crowded", "s", F.col(name).bitwiseAND(F.col("mask")).alias("b"))

    def first_agreed(masks):
        return F.array_position(F.transform(masks, lambda mask: F.col("apart").bitwiseAND(mask) == 0), True) - 1

    met = parted(queries, "bits").join(parted(rows, "near"), ["t", "a", "crowded", "s", "b"]).where(F.col("bits") != F.col("near"))
    met = met.withColumn("apart", F.col("bits").bitwiseXOR(F.col("near"))).withColumn("distance", F.bit_count("apart"))
    met = met.where(F.col("distance") <= radius).where(first_agreed(coarse) == F.col("t"))
    return met.where(~F.col("crowded") | (first_agreed(fine) == F.col("s"))).select("bits", "near", "distance")


def _with_run(documents: DataFrame) -> DataFrame:
    """Adds the number of the run of neighbouring ids a row is in; ids fall and runs rise.

    Approximate quantiles part the runs, so they are even however the ids lie.
    Null ids get a run of their own after the others.
    """
    rows = documents.count()
    runs = min(max(2, -(-rows // RUN_ROWS)), MOST_RUNS)
    marks = documents.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], max(10_000, 4 * runs))).head()[0]
    cuts = sorted({float(mark) for mark in marks or [0]})
    parted = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_at", handleInvalid="keep")
    numbered = parted.transform(documents.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
    run = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.col("_at").cast("int"))
    return numbered.withColumn("run", run).drop("_id", "_at")


def with_next(documents: DataFrame) -> DataFrame:
    """run, place, doc_id, text, next_text: each row's text and that of the next, descending doc_id, then round.

    A run of neighbouring ids is ordered in one task; the head of each run also
    goes to the run before it. Null ids form a run of their own at the end.
    """
    rows = _with_run(documents.select("doc_id", common.text_or_empty().alias("text")))
    down = [F.desc_nulls_last("doc_id"), F.asc("text")]
    heads = rows.groupBy("run").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("run")
    # One row per run, at most MOST_RUNS: each head and the run it also goes to.
    ring = heads.withColumn("to", F.lag("run").over(order)).withColumn(
        "to", F.coalesce("to", F.max("run").over(Window.partitionBy(F.lit(1))))
    )
    ring = ring.select(F.col("run").alias("_run"), "head", "to")
    met = (F.col("run") == F.col("_run")) & F.col("doc_id").eqNullSafe(F.col("head"))
    ghosts = rows.join(F.broadcast(ring), met)
    # Rows that share the head's id: the first by text is the head.
    ghosts = ghosts.groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(
        ghosts.select("doc_id", "text", F.col("to").alias("run"), F.lit(True).alias("_ghost"))
    )
    inside = Window.partitionBy("run").orderBy("_ghost", *down)
    return (
        both.withColumn("place", F.row_number().over(inside))
        .withColumn("next_text", F.lead("text").over(inside))
        .where("NOT _ghost")
        .select("run", "place", "doc_id", "text", "next_text")
    )


def edited(rows: DataFrame) -> DataFrame:
    """Adds n_chars and `edited`: the last third of the code points replaced by the first of the next text."""
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn(
        "edited",
        F.expr("concat(substr(text, 1, cast(n_chars - n_chars div 3 AS int)), substr(coalesce(next_text, ''), 1, cast(n_chars div 3 AS int)))"),
    )


def compare(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_prints.

    near_prints is the number of other fingerprints of the table within RADIUS bits.
    """
    rows = edited(with_next(documents))
    keys = ["run", "place", "doc_id", "n_chars", "edited_sha256", "side"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    two = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "run", "place", "doc_id", "n_chars", "edited_sha256", sides.alias("_s")
    )
    two = two.select("run", "place", "doc_id", "n_chars", "edited_sha256", "_s.side", "_s.text")
    marked = fingerprints(two, keys)
    one = marked.groupBy("run", "place", "doc_id", "n_chars", "edited_sha256").agg(
        F.max(F.when(F.col("side") == 0, F.col("bits"))).alias("bits"),
        F.max(F.when(F.col("side") == 1, F.col("bits"))).alias("edited_bits"),
    )
    # The next fingerprint: within the run by its place, at its end from the head of the next run.
    narrow = common.staged(one, "simhash")
    heads = narrow.where("place = 1").select("run", F.col("bits").alias("head_bits"))
    order = Window.orderBy("run")
    ring = heads.withColumn("after", F.lead("head_bits").over(order)).withColumn(
        "after", F.coalesce("after", F.first("head_bits").over(order))
    )
    inside = Window.partitionBy("run").orderBy("place")
    nexts = narrow.withColumn("_next", F.lead("bits").over(inside)).join(F.broadcast(ring.select("run", "after")), "run")
    nexts = nexts.withColumn("_next", F.coalesce("_next", "after"))
    prints = common.staged(narrow.groupBy("bits").agg(F.count("*").alias("_rows")), "fingerprints")
    near = within_radius(prints, prints).groupBy("bits").agg(F.count("*").alias("near_prints"))
    near = prints.join(near, "bits", "left").withColumn("near_prints", F.coalesce("near_prints", F.lit(0).cast("bigint")))
    nexts = skew.attach_key_figures(nexts, near, "bits", "_rows", "place", hot_rows=HOT_ROWS)
    return nexts.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("bits")).alias("fingerprint"),
        as_text(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("_next")).alias("near_next"),
        "near_prints",
    )
