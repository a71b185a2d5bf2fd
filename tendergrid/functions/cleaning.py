"""Turn landing-page text into typed columns. Bad input becomes NULL, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(text: Column) -> Column:
    """Only texts that begin or end with something else than visible ASCII are searched for white space."""
    ends = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(ends, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def iso_date(text: Column) -> Column:
    """The leading yyyy-MM-dd as a date. Shorter forms Spark would accept are refused."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def money(text: Column) -> Column:
    """Drop everything but digits, dot and minus; two dots or a stray minus give NULL."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def year_or_zero(date: Column) -> Column:
    return F.coalesce(F.year(date), F.lit(0)).cast("int")


def unwrap_url(text: Column) -> Column:
    """The url of a {"url": ...} object; text that is no such object stays as it is."""
    return F.coalesce(F.get_json_object(text, "$.url"), text)


def hash_bytes(text: Column) -> Column:
    """The 32 bytes of a hash as text_hash writes it; other text gives NULL."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.unhex(text))


def text_hash(columns: list[str]) -> Column:
    """SHA-256 of the values in order, NULL as empty text, with a pipe between them."""
    texts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in columns]
    return F.sha2(F.concat_ws("|", *texts), 256)
