"""Mix sources to target weights on a low-discrepancy schedule; DataFrame functions only.

The size of a document is its number of words. Sources, ordered by code point
with null last, weigh WEIGHTS in turn and share SHARE times all words; a target
stops at MOST times its source's size and the excess goes to the others by weight (the
water level, found from running sums over sources ordered by size per weight).

Each source's documents, shuffled by hash, lie end to end on a line of words
that is cut into equal blocks. Slot i of the schedule has the golden-ratio point
frac(i / phi); cumulative weights map it to a source, and its rank among that
source's slots names the block it takes, the line repeating from its start.
Ranks and places on the lines are running sums in two levels (within a chunk or
bucket, and over them), so no source's rows meet in one task. Slots beyond MOST
times the line are left empty.

Null text counts as empty: size 0, taken 0. Sources of size 0 have target 0. Ties and repeated rows are
told apart by their place on the line; null ids are a value like any other. An
empty table gives an empty result. Reruns agree: everything follows from hashes of the rows.
"""

import decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendergrid.llm import common

WEIGHTS = [3, 1, 2]
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 256  # fewer for sources under 256 blocks of it
LEAST_BLOCKS = 256
BUCKET_ROWS = 2048
CHUNK_SLOTS = 4096
CELLS = 1024
SEED = 20_011

_SPACES = "\t\n\x0b\f\r"


def words_of(text: str = "text") -> Column:
    """Number of runs of other characters than the space and 0x09 to 0x0D."""
    parts = F.split(F.translate(common.text_or_empty(text), _SPACES, " " * len(_SPACES)), " ", -1)
    return F.size(F.array_remove(parts, "")).cast("bigint")


def fold_of(documents: DataFrame) -> Column:
    """A hash of the text, and of lang where there is one."""
    lang = [F.coalesce("lang", F.lit("\0"))] if "lang" in documents.columns else []
    return F.xxhash64(common.text_or_empty(), *lang)


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: number, size, rows, target, block; from rows with source and size."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    numbered = sizes.withColumn("number", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.lit(WEIGHTS), ((F.col("number") - 1) % len(WEIGHTS) + 1).cast("int"))
    )
    everything = Window.partitionBy(F.lit(1))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything) * F.lit(SHARE)
    cap = F.col("source_size") * MOST
    # If all sources before it stop at their caps, does this one stop too?
    left = wanted - F.coalesce(F.sum(cap).over(filled), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    level = (
        numbered.withColumn("_full", cap * share <= left * F.col("weight"))
        .withColumn("_left", wanted - F.coalesce(F.sum(F.when(F.col("_full"), cap)).over(everything), F.lit(0)))
        .withColumn("_share", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("_full"), cap.cast("double")).otherwise(F.col("_left") * F.col("weight") / F.col("_share"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.ceil(F.col("source_size") / LEAST_BLOCKS)))
    return level.select("source", "number", "source_size", "rows", target.alias("target"), block.cast("bigint").alias("block"))


def _running(rows: DataFrame, group: str, part: str, order: list, amount: str, name: str) -> DataFrame:
    """Adds the sum of `amount` over all rows of the group before this one: parts in order, rows in order within."""
    totals = rows.groupBy(group, part).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(totals, [group, part]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, number, rank: the source of each slot and the slot's rank among that source's."""
    order = Window.orderBy("number")
    weighed = sources.where("target > 0").withColumn("_n", F.col("target") / F.col("block"))
    cumulative = weighed.withColumn("high", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    ranges = cumulative.select(
        "number", ((F.col("high") - F.col("_n")) / F.col("_all")).alias("low"), (F.col("high") / F.col("_all")).alias("high")
    )
    # Cells of the unit interval turn the look-up into a join on equal keys.
    last = F.lit(CELLS - 1)
    ranges = ranges.withColumn(
        "cell",
        F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), last), F.least(F.floor(F.col("high") * CELLS), last))),
    )
    with decimal.localcontext(prec=60):
        golden = (decimal.Decimal(5).sqrt() - 1) / 2
        coarse = float(golden * 2**20 % 1)
        fine = float(golden)
    # In two steps, so that large slot numbers lose no digits.
    point = (F.shiftright("slot", 20) * coarse) % 1 + (F.col("slot").bitwiseAND(F.lit((1 << 20) - 1)) * fine) % 1
    points = (
        sources.sparkSession.range(slots).withColumnRenamed("id", "slot")
        .withColumn("point", point % 1)
        .withColumn("cell", F.least(F.floor(F.col("point") * CELLS), last))
    )
    top = (F.col("high") >= 1 - 1e-12) & (F.col("point") >= F.col("low"))
    placed = points.join(ranges, "cell").where(((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high"))) | top)
    placed = placed.select("slot", "number", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"), F.lit(1).cast("bigint").alias("one"))
    return _running(placed, "number", "chunk", ["slot"], "one", "rank").select("slot", "number", "rank")


def lines(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of positive size with number, block, line (the source's words) and `start` on the line."""
    shuffled = F.xxhash64(F.lit(SEED), "doc_id", "fold")
    known = sources.select("source", "number", "rows", "block", F.col("source_size").alias("line"))
    placed = rows.where("size > 0").withColumn("order", shuffled).join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    placed = placed.withColumn("bucket", F.pmod("order", F.ceil(F.col("rows") / BUCKET_ROWS)))
    return _running(placed, "number", "bucket", ["order", F.asc_nulls_last("doc_id"), "fold", "size"], "size", "start")


def plan(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged sources with their targets, and per row doc_id, fold, source, size and first, second:
    the words taken on the first and on the second pass over the line, always the document's first ones.

    `fold` is a hash of text and lang; rows of equal doc_id, fold and source differ in nothing that matters here.
    """
    rows = common.staged(
        documents.select("doc_id", "source", words_of().alias("size"), fold_of(documents).alias("fold")), "mix-rows"
    )
    sources = common.staged(targets(rows), "mix-sources")
    slots = sources.agg(F.ceil(F.sum(F.col("target") / F.col("block")))).head()[0] or 0
    drawn = schedule(sources, int(slots)).join(sources.select("number", "block", F.col("source_size").alias("line")), "number")
    blocks = F.ceil(F.col("line") / F.col("block"))
    taken = (
        drawn.where(F.col("rank") < blocks * MOST)
        .withColumn("at", F.col("rank") % blocks)
        .groupBy("number", "at")
        .agg(F.count("*").alias("times"))
    )
    placed = lines(rows, sources)
    key = ["number", "start", "doc_id", "fold", "source", "size"]
    end = F.col("start") + F.col("size")
    pieces = placed.withColumn(
        "at", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block"))))
    )
    share = F.least(end, (F.col("at") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("at") * F.col("block"))
    met = pieces.withColumn("share", share).join(taken, ["number", "at"], "left")
    summed = met.groupBy(*key).agg(
        F.sum(F.when(F.col("times") >= 1, F.col("share")).otherwise(0)).alias("first"),
        F.sum(F.when(F.col("times") >= 2, F.col("share")).otherwise(0)).alias("second"),
    )
    columns = ["doc_id", "fold", "source", "size", "first", "second"]
    none = F.lit(0).cast("bigint")
    idle = rows.where("size = 0").withColumn("first", none).withColumn("second", none)
    return sources, summed.select(*columns).unionByName(idle.select(*columns))


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    sources, rows = plan(documents)
    known = sources.select("source", "source_size", "target")
    met = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    return met.select("doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: a row with the words taken for each pass that takes any of a document.

    Rows of equal doc_id, text, source and lang are copies of each other; only how often which
    number of words is taken of them is counted, so copies never meet in one task.
    """
    documents = documents.select(*common.DOCUMENT_COLUMNS)
    key = ["doc_id", "fold", "source"]
    taken = plan(documents)[1].where("first > 0").select(*key, "size", F.explode(F.array("first", "second")).alias("_words"))
    passes = taken.where("_words > 0").groupBy(*key, F.col("size").alias("_size"), "_words").agg(F.count("*").alias("_times"))
    passes = passes.select(*[F.col(name).alias(f"_{name}") for name in key], "_size", "_words", "_times")
    folded = documents.withColumn("fold", fold_of(documents))
    single = folded.groupBy(*key, "lang").agg(F.first("text").alias("text"))
    same = single["doc_id"].eqNullSafe(passes["_doc_id"]) & (single["fold"] == passes["_fold"]) & single["source"].eqNullSafe(passes["_source"])
    met = single.join(passes, same).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    begin = F.expr(
        r"regexp_extract(text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', _words, '}+'), 0)"
    )
    text = F.when(F.col("_words") < F.col("_size"), begin).otherwise(F.col("text"))
    return met.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*common.DOCUMENT_COLUMNS)
