"""Upsert by contract key with change detection by row hash.

The table can be far larger than a batch, so only its key, hash and year take
part in finding out what a batch changes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEY, ROW_HASH, UPDATED_AT, YEAR

ACTION = "accion"
PRIOR_YEAR = "anio_previo"
INSERTED, UPDATED, UNCHANGED, STALE = "inserted", "updated", "unchanged", "stale"


def with_key(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(KEY).isNotNull())


def without_key(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(KEY).isNull())


def rejected_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col(KEY).isNull()).alias("rechazados"))


def latest_versions(batch: DataFrame) -> DataFrame:
    """One row per key: the newest update, among equals the greatest hash.

    Rows equal in both are copies of each other. Only the first row of a key
    is asked for, so each map task already cuts a key down to one row and a
    key with very many copies does not end up in one task.
    """
    order = Window.partitionBy(KEY).orderBy(
        F.col(UPDATED_AT).desc_nulls_last(), F.col(ROW_HASH).desc_nulls_last()
    )
    return (
        with_key(batch)
        .withColumn("_version", F.row_number().over(order))
        .where("_version = 1")
        .drop("_version")
    )


def repeated_keys(batch: DataFrame) -> DataFrame:
    """Hashes of keys that come more than once, and by chance some that share a hash; eight bytes a row are shuffled."""
    hashed = with_key(batch).groupBy(F.xxhash64(KEY).alias("_clave")).agg(F.count(F.lit(1)).alias("_n"))
    return hashed.where("_n > 1").select("_clave")


def superseded(batch: DataFrame, repeated: DataFrame, place: list[str]) -> DataFrame:
    """Where the rows are that latest_versions leaves out for another one of their key; place tells rows apart.

    Only rows with a repeated key (see repeated_keys) are compared.
    """
    some = with_key(batch).join(repeated, F.xxhash64(KEY) == F.col("_clave"), "left_semi")
    return some.select(*place).join(latest_versions(some).select(*place), place, "left_anti")


def classify(existing: DataFrame, batch: DataFrame, keys: DataFrame | None = None, also: list[str] | None = None) -> DataFrame:
    """The batch with what it does to the table, and the year the contract had before.

    existing has unique keys, the batch has unique non-null keys. The batch
    keys (or `keys`, if they can be had at less cost; repeats do no harm)
    first cut the table down; Spark broadcasts them when their measured bytes
    are few. A row older than the stored one is stale: it changes nothing.
    also names columns of the table to be had with the verdict.
    """
    keys = batch.select(KEY) if keys is None else keys
    prior = existing.select(
        KEY,
        F.col(ROW_HASH).alias("_prior_hash"),
        F.col(YEAR).alias(PRIOR_YEAR),
        F.col(UPDATED_AT).alias("_prior_at"),
        F.lit(True).alias("_known"),
        *(also or []),
    ).join(keys, KEY, "left_semi")
    decided = batch.join(prior, KEY, "left").withColumn(ACTION, _action())
    return decided.drop("_prior_hash", "_prior_at", "_known")


def _stale(incoming: Column, stored: Column) -> Column:
    """Whether the incoming update time is known to lie before the stored one."""
    return F.coalesce(incoming < stored, F.lit(False))


def _action() -> Column:
    return (
        F.when(F.col("_known").isNull(), INSERTED)
        .when(F.col("_prior_hash").eqNullSafe(F.col(ROW_HASH)), UNCHANGED)
        .when(_stale(F.col(UPDATED_AT), F.col("_prior_at")), STALE)
        .otherwise(UPDATED)
    )


def only_actions(changes: DataFrame, *actions: str) -> DataFrame:
    return changes.where(F.col(ACTION).isin(*actions)).drop(ACTION, PRIOR_YEAR)


def merge_inserts(existing: DataFrame, batch: DataFrame) -> DataFrame:
    return latest_versions(batch).join(existing.select(KEY), KEY, "left_anti")


def merge_updates(existing: DataFrame, batch: DataFrame) -> DataFrame:
    prior = existing.select(
        KEY, F.col(ROW_HASH).alias("_prior_hash"), F.col(UPDATED_AT).alias("_prior_at")
    )
    return (
        latest_versions(batch)
        .join(prior, KEY)
        .where(~F.col("_prior_hash").eqNullSafe(F.col(ROW_HASH)))
        .where(~_stale(F.col(UPDATED_AT), F.col("_prior_at")))
        .drop("_prior_hash", "_prior_at")
    )


def merge_unchanged(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows the table already has in the same form: key and hash both match."""
    return latest_versions(batch).join(
        existing.select(KEY, ROW_HASH), [KEY, ROW_HASH], "left_semi"
    )


def key_difference(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def union_relaxed(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns missing on one side become NULL, numbers widen to the larger type."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def keep_unreplaced(existing: DataFrame, keys: DataFrame, at: str | Column = KEY) -> DataFrame:
    """Rows without a match in keys, by default for the contract key."""
    return existing.join(keys, at, "left_anti")


def merge_silver(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """existing - updated + inserted + updated; merging the same batch twice changes nothing.

    One full outer join reads each side once. It moves the whole table, which
    is right when the batch is of similar size; a load of a small batch into a
    stored table goes through classify and keep_unreplaced instead.
    """
    latest = latest_versions(batch)
    old, new = existing.columns, latest.columns
    incoming = latest.select(*[F.col(name).alias(f"_new_{name}") for name in new])
    both = existing.join(incoming, F.col(KEY) == F.col(f"_new_{KEY}"), "full_outer")
    take_new = F.col(f"_new_{KEY}").isNotNull() & (
        F.col(KEY).isNull()
        | ~F.col(ROW_HASH).eqNullSafe(F.col(f"_new_{ROW_HASH}"))
        & ~_stale(F.col(f"_new_{UPDATED_AT}"), F.col(UPDATED_AT))
    )
    values = []
    for name in old + [name for name in new if name not in old]:
        value = F.when(take_new, F.col(f"_new_{name}") if name in new else F.lit(None))
        values.append((value.otherwise(F.col(name)) if name in old else value).alias(name))
    return both.select(*values)


def merge_metrics(changes: DataFrame) -> DataFrame:
    return changes.agg(
        *[F.count_if(F.col(ACTION) == name).alias(name) for name in (INSERTED, UPDATED, UNCHANGED, STALE)]
    )


def affected_years(changes: DataFrame) -> DataFrame:
    """Years that gain, change or lose a contract: an update counts for its old year too."""
    touched = changes.where(F.col(ACTION).isin(INSERTED, UPDATED))
    return (
        touched.select(F.explode(F.array(YEAR, PRIOR_YEAR)).alias(YEAR))
        .where(F.col(YEAR).isNotNull())
        .distinct()
    )


def new_watermark(batch: DataFrame, previous: str | None = None) -> DataFrame:
    """The greatest update time seen so far. ISO text orders like time."""
    return batch.agg(
        F.greatest(F.max(UPDATED_AT), F.lit(previous).cast("string")).alias("watermark")
    )
