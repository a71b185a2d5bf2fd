"""Join per-key figures back to rows when one key may hold a large part of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this share of all rows is cut into pieces. At most
# 1 / HOT_SHARE keys can be that large, which bounds the broadcast below to
# ten thousand rows on any input.
HOT_SHARE = 1e-4
# Below this many rows a key is never worth cutting.
HOT_ROWS = 500_000


def attach_key_figures(
    rows: DataFrame,
    figures: DataFrame,
    key: str,
    size: str,
    spread: str,
    hot_share: float = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of rows with figures, which has one row per key and counts its rows in `size`.

    A window over the key would bring all rows of a key into one task. Here
    the rows of a large key are spread over pieces by the hash of `spread`,
    and only the figures of those keys are repeated, once per piece. The
    pieces of all large keys together number at most twice 1 / hot_share.
    """
    all_rows = figures.select(size).agg(F.sum(size)).scalar()
    piece_rows = F.greatest(all_rows * hot_share, F.lit(float(hot_rows)))
    pieces = F.ceil(F.col(size) / piece_rows).cast("int")
    cut = figures.withColumn("_pieces", pieces)
    hot = cut.where("_pieces > 1").select(key, F.col("_pieces").alias("_hot_pieces"))
    spread_rows = (
        rows.where(F.col(key).isNotNull())
        .join(F.broadcast(hot), key, "left")
        .withColumn(
            "_piece",
            F.coalesce(F.pmod(F.xxhash64(spread), F.col("_hot_pieces")), F.lit(0)).cast("int"),
        )
        .drop("_hot_pieces")
    )
    repeated = cut.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))
    ).drop("_pieces")
    return spread_rows.join(repeated, [key, "_piece"]).drop("_piece")
