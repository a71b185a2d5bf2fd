"""Landing rows to typed rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning
from ..schemas import (
    DATE_COLUMNS,
    MONEY_COLUMNS,
    PAGE_BUSINESS_COLUMNS,
    PAGE_TO_SILVER,
    ROW_HASH,
    SENSITIVE_COLUMNS,
    SILVER_COLUMNS,
    UPDATED_AT,
    YEAR,
)


def rename_columns(rows: DataFrame) -> DataFrame:
    """Landing names to table names; names the table does not know stay."""
    return rows.withColumnsRenamed(PAGE_TO_SILVER)


def _replace(rows: DataFrame, names: list[str], change) -> DataFrame:
    known = set(rows.columns)
    return rows.withColumns({name: change(F.col(name)) for name in names if name in known})


def cast_dates(rows: DataFrame) -> DataFrame:
    return _replace(rows, DATE_COLUMNS, lambda c: cleaning.iso_date(c.cast("string")))


def cast_money(rows: DataFrame) -> DataFrame:
    return _replace(rows, MONEY_COLUMNS, lambda c: cleaning.money(c.cast("string")))


def clean_strings(rows: DataFrame) -> DataFrame:
    names = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    return _replace(rows, names, cleaning.strip_text)


def extract_year(rows: DataFrame) -> DataFrame:
    if "fecha_firma" not in rows.columns:
        return rows.withColumn(YEAR, F.lit(0))
    return rows.withColumn(YEAR, cleaning.year_or_zero(F.col("fecha_firma")))


def row_hash(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add the hash of the business columns.

    The year follows from a date and the update time says nothing about the
    contract, so neither takes part; every amount does.
    """
    skip = {ROW_HASH, YEAR, UPDATED_AT}
    names = columns or [name for name in rows.columns if name not in skip]
    return rows.withColumn(ROW_HASH, cleaning.text_hash(names))


_CLEAN = {
    "text": cleaning.strip_text,
    "date": cleaning.iso_date,
    "money": cleaning.money,
    "url": lambda c: cleaning.strip_text(cleaning.unwrap_url(c)),
}


def bronze_to_silver(pages: DataFrame) -> DataFrame:
    """The whole projection in one select: renames, casts, trimming, year and hash.

    The hash is taken from the landing text, so it does not change with the
    way numbers or dates are printed.
    """
    known = set(pages.columns)
    absent = [name for name in PAGE_BUSINESS_COLUMNS + [UPDATED_AT] if name not in known]
    if absent:
        pages = pages.withColumns({name: F.lit(None).cast("string") for name in absent})
    typed = [_CLEAN[kind](F.col(page)).alias(silver) for silver, page, kind in SILVER_COLUMNS]
    return pages.select(
        *typed,
        cleaning.strip_text(F.col(UPDATED_AT)).alias(UPDATED_AT),
        cleaning.year_or_zero(cleaning.iso_date(F.col("fecha_de_firma"))).alias(YEAR),
        cleaning.text_hash(PAGE_BUSINESS_COLUMNS).alias(ROW_HASH),
    )


def url_unwrap(rows: DataFrame) -> DataFrame:
    return _replace(rows, ["url_proceso"], cleaning.unwrap_url)


def pseudonym(value: Column, salt: str) -> Column:
    """A salted hash; without the salt an id number is found again by trying them all."""
    if not salt:
        raise ValueError("pseudonyms need a secret salt")
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def public_projection(rows: DataFrame, salt: str | None = None) -> DataFrame:
    """Without the sensitive columns, or, given a salt, with a hash in their place to keep rows linkable."""
    if salt is None:
        return rows.drop(*SENSITIVE_COLUMNS)
    return _replace(rows, SENSITIVE_COLUMNS, lambda c: pseudonym(c, salt))
