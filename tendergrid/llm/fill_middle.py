r"""Fill-in-middle: a text is cut in three by one regular expression and put together in another order.

`regexp_count` gives the number of code points n. From it and three draws per
row come the cuts a <= b; the pattern `(.{a}+)(.{b-a}+)(.*+)` of that row takes
prefix, middle and suffix in a single match, and the replacement names them in
the order of the form. Counted possessive quantifiers never go back, so a match
is one walk along the text. All of it is column functions; nothing is shuffled.

Code points are counted in blocks of BLOCK, then the few that are left one by
one: `regexp_count` keeps all it has matched, and one entry per code point of a
long text would be many times the text.

Null text counts as empty; empty texts and texts that hold a marker stay plain.
A null doc_id draws as if it were written as an empty text. Repeated rows are
cut alike, an empty table gives an empty result, and only doc_id and the text
column are read, so further columns cannot clash.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of prefix, suffix and middle; forms.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Of 100: documents that are cut, and those among them with the suffix first.
CUT_SHARE, SPM_SHARE = 90, 20
# Code points counted as one match.
BLOCK = 1024


def n_code_points(text: Column) -> Column:
    blocks = F.lit(f"(?s).{{{BLOCK}}}+")
    rest = F.regexp_replace(text, blocks, F.lit(""))
    whole = F.regexp_count(text, blocks).cast("bigint") * BLOCK
    return whole + F.regexp_count(rest, F.lit("(?s).")).cast("bigint")


def draws(key: Column, seed: str, number: int) -> list[Column]:
    """Unsigned 32-bit draws: the first groups of eight digits of a digest of seed and key."""
    digits = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(number)]


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers found in an output are those put there only if none can begin inside another."""
    starts = {mark[:1] for mark in markers}
    if len(set(markers)) < 3 or "" in starts or any(set(mark[1:]) & starts for mark in markers):
        raise ValueError(f"markers {markers} could be mistaken for each other")
    if any(a != b and b.startswith(a) for a in markers for b in markers):
        raise ValueError(f"one of the markers {markers} begins another")
    return markers


def _literal(mark: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", mark)


def transform(
    documents: DataFrame,
    text: str = "text",
    seed: str = "1:",
    cut_share: int = CUT_SHARE,
    spm_share: int = SPM_SHARE,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """doc_id, text (null: empty), n, form, prefix_chars, middle_chars (null if plain), output."""
    prefix, suffix, middle = map(_literal, _checked(markers))
    rows = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    first, second, to_cut, order = draws(F.col("doc_id"), seed, 4)
    rows = rows.select("*", n_code_points(F.col("text")).alias("n"), first.alias("h1"), second.alias("h2"), to_cut.alias("h3"), order.alias("h4"))
    marked = F.lit(False)
    for mark in markers:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= cut_share)
    form = F.when(plain, PLAIN).when(F.col("h4") % 100 < spm_share, SPM).otherwise(PSM)
    ends = [F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)]
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    length = F.col("b") - F.col("a")
    pattern = F.concat(F.lit(r"(?s)\A(.{"), F.col("a"), F.lit(r"}+)(.{"), length, F.lit(r"}+)(.*+)\z"))
    layout = F.when(F.col("form") == PSM, f"{prefix}$1{suffix}$3{middle}$2").otherwise(f"{suffix}$3{prefix}$1{middle}$2")
    cut = F.col("form") != PLAIN
    return rows.select(
        "doc_id", "text", "n", "form",
        F.when(cut, F.col("a")).alias("prefix_chars"),
        F.when(cut, length).alias("middle_chars"),
        F.when(cut, F.regexp_replace("text", pattern, layout)).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of the form was made from."""
    prefix, suffix, middle = (re.sub(r"([^A-Za-z0-9])", r"\\\1", mark) for mark in _checked(markers))
    of_psm = F.regexp_replace(output, F.lit(rf"(?s)\A{prefix}(.*?){suffix}(.*?){middle}(.*+)\z"), F.lit("$1$3$2"))
    of_spm = F.regexp_replace(output, F.lit(rf"(?s)\A{suffix}(.*?){prefix}(.*?){middle}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == PSM, of_psm).when(form == SPM, of_spm).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, lengths of prefix and middle, digests of the output and of the text rebuilt from it."""
    return transform(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
