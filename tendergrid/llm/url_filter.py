"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides are the training material: smoothed variable-order
Markov models (orders 0 to ORDER, each backed off into the shorter one) of the
accepted and of the rejected ones. The symbol counts cover every such URL but
those held out for calibration; they are gathered per partition and added up by symbol string, so at most
2 * 40^4 rows reach the driver whatever the number of URLs. The score is the
log-likelihood difference per character; its threshold balances the errors on
the rule-decided URLs that were held out (one in five, by hash).

Null URLs and those without `://` have an empty host and path, fit no rule and
are judged by the models on what text there is. Without training material for
both sides every undecided URL is allowed. Repeated rows each get their
verdict; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendergrid.llm import common

# (host, path) pairs with their verdict; the longest that fits wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 3
STRENGTH = 2.0

# Symbols of the models: letters, one for all digits, common marks, one for the rest. Symbol 0 starts a URL.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%+~"
SYMBOLS = len(_ALPHABET) + 1
_SYMBOL = np.full(128, SYMBOLS - 1, np.int64)
for _number, _member in enumerate(_ALPHABET):
    _SYMBOL[ord(_member)] = _number
_SYMBOL[ord("1") : ord("9") + 1] = _ALPHABET.index("0")
_START = SYMBOLS - 1


def split(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, host and path; only A-Z are lowered."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(*keep, lowered.alias("host"), path.alias("path"))


def with_rule(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds the longest fitting rule (null for none) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def _symbols(url: str) -> np.ndarray:
    """ORDER start marks, then the symbols of a whole URL."""
    points = np.frombuffer(url.lower().encode("utf-32-le"), np.uint32)
    own = np.where(points < 128, _SYMBOL[np.minimum(points, 127)], SYMBOLS - 1)
    return np.concatenate([np.full(ORDER, _START), own])


def _codes(urls) -> tuple[np.ndarray, np.ndarray]:
    """A number for each symbol with the ORDER before it, over all URLs, and each URL's length."""
    parts, lengths = [], []
    for url in urls:
        own = _symbols(url or "")
        code = np.zeros(len(own) - ORDER, np.int64)
        for back in range(ORDER + 1):
            code = code * SYMBOLS + own[back : len(own) - ORDER + back]
        parts.append(code)
        lengths.append(len(code))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(lengths, np.int64)


def counts(rows: DataFrame) -> DataFrame:
    """verdict, code, n over all rule-decided URLs that are not held out."""

    def count(batches):
        for batch in batches:
            for kind, own in batch.groupby("ruled"):
                code, n = np.unique(_codes(own["url"])[0], return_counts=True)
                yield pd.DataFrame({"ruled": kind, "code": code, "n": n})

    taught = rows.where("ruled IS NOT NULL AND NOT aside").select("ruled", "url")
    return taught.mapInPandas(count, "ruled string, code long, n long").groupBy("ruled", "code").agg(F.sum("n").alias("n"))


def log_ratio(table: pd.DataFrame) -> np.ndarray:
    """log p(symbol | context) of the accepted less that of the rejected, by code."""
    sides = []
    for kind in ("allow", "block"):
        own = table[table["ruled"] == kind]
        full = np.zeros(SYMBOLS ** (ORDER + 1))
        full[own["code"].to_numpy(np.int64)] = own["n"].to_numpy(float)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(ORDER + 1):
            n = full.reshape(-1, SYMBOLS ** (order + 1)).sum(0).reshape(-1, SYMBOLS)
            # The shorter context drops the oldest symbol, so its distributions repeat.
            shorter = np.tile(p.reshape(-1, SYMBOLS), (max(1, len(n) * SYMBOLS // p.size), 1))
            p = (n + STRENGTH * shorter) / (n.sum(1, keepdims=True) + STRENGTH)
            p = p.reshape(-1)
        sides.append(np.log(p))
    return (sides[0] - sides[1]).astype(np.float32)


def fit(rows: DataFrame):
    """The table of log ratios and the calibrated threshold, or None without material for both sides."""
    table = counts(rows).orderBy("ruled", "code").toPandas()  # bounded by the alphabet
    if table["ruled"].nunique() < 2:
        return None
    ratio = log_ratio(table)
    # Scores on a grid of hundredths, counted per side: bounded as well.
    aside = scored(rows.where("ruled IS NOT NULL AND aside"), ratio)
    grid = aside.groupBy("ruled", F.round("score", 2).alias("s")).count().toPandas()
    threshold = 0.0
    if grid["ruled"].nunique() == 2:
        share = grid["count"] / grid.groupby("ruled")["count"].transform("sum")
        cuts = np.sort(np.unique(np.concatenate([grid["s"], [0.0]])))
        wrong = [
            float(share[(grid["ruled"] == "allow") & (grid["s"] < c)].sum() + share[(grid["ruled"] == "block") & (grid["s"] >= c)].sum())
            for c in cuts
        ]
        best = [c for c, w in zip(cuts, wrong, strict=True) if w <= min(wrong) + 1e-12]
        threshold = float(min(best, key=lambda c: (abs(c), c)))
    return ratio, threshold


def scored(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Adds the length-normalised log-likelihood difference; 0 for empty URLs."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        code, lengths = _codes(urls)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        total = np.bincount(owner, shared.value[code], len(lengths))
        return pd.Series(total / np.maximum(lengths, 1))

    return rows.withColumn("score", score("url"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    rows = with_rule(split(pages, ["page_id", "url"]), rules).withColumn(
        "aside", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(5)) == 0
    )
    model = fit(rows)
    if model is None:
        judged = rows.withColumn("score", F.lit(0.0)).withColumn("own", F.lit("allow"))
    else:
        judged = scored(rows, model[0]).withColumn("own", F.when(F.col("score") >= model[1], "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "own").alias("verdict"), "score")
