"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and so has every chosen pair.
The tables are learnt by cyclic boosting: in turn, each gets a shallow tree fit
to the gradient of the logistic loss, added with a small step. Scoring adds up
the bins, vectorised. The model is fit on a bounded sample of labelled rows
(`SAMPLE_ROWS`, by the smallest hash of doc_id), whose features are made for the
fit alone; then one pass over all rows makes features of whole texts and scores them.

Inputs of a score are the text's own figures only. Null text counts as empty;
empty texts score by the features of an empty text. Rows without doc_id are
scored and never learnt from; repeated rows each get their score; documents
with several labels count once per label. Without labels of both kinds the
score is the share of label 1, or 0.5. Empty tables give empty results.
"""

from collections import Counter
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendergrid.llm import common

SAMPLE_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
STEP = 0.15
ACCEPT = 0.3

FEATURES = [
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "marks", "symbols", "spaces",
    "other_script", "distinct", "commonest", "doubled", "short_words", "ending_mark", "lines", "repeated_lines",
    "bars", "shouts", "byte_entropy",
]


def _class(members: bytes) -> np.ndarray:
    flags = np.zeros(256)
    flags[list(members)] = 1
    return flags


_BYTE_CLASSES = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(bytes(range(48, 58))),
        _class(b".,;:?'\"()"),
        _class(b"#$%&*@^~=+<>|_{}[]\\/"),
        _class(b" \t\n\r"),
        _class(bytes(range(128, 256))),
        _class(b"|"),
        _class(b"!"),
        _class(b"\n"),
    ]
)


def features_of(text: str) -> list[float]:
    """Figures of one whole text, linear in its length."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    size = max(len(data), 1)
    upper, digits, marks, symbols, spaces, other, bars, shouts, breaks = _BYTE_CLASSES @ counts
    shares = counts[counts > 0] / size
    words = text.split()
    many = max(len(words), 1)
    tally = Counter(words)
    lengths = Counter(map(len, words))
    lines = text.split("\n")
    ending = sum(n for word, n in tally.items() if not word[-1].isalnum())
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(length * n for length, n in lengths.items()) / many,
        max(lengths, default=0),
        upper / size,
        digits / size,
        marks / size,
        symbols / size,
        spaces / size,
        other / size,
        len(tally) / many,
        max(tally.values(), default=0) / many,
        sum(map(eq, words, words[1:])) / many,
        sum(n for length, n in lengths.items() if length <= 3) / many,
        ending / many,
        breaks / many,
        1 - len(set(lines)) / len(lines),
        bars / many,
        shouts / many,
        float(-(shares * np.log2(shares)).sum()),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _figures(texts: pd.Series) -> pd.Series:
    return pd.Series([features_of(text or "") for text in texts], dtype=object)


def _boost(bins: np.ndarray, size: int, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves over ordered bins, as one value per bin."""
    g = np.bincount(bins, gradient, size)
    h = np.bincount(bins, hessian, size)
    leaves = [(0, size)]
    for _ in range(3):
        best = (1e-9, None, None)
        for low, high in leaves:
            cg, ch = np.cumsum(g[low:high]), np.cumsum(h[low:high])
            gain = cg**2 / (ch + 1) + (cg[-1] - cg) ** 2 / (ch[-1] - ch + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            cut = int(np.argmax(gain[:-1])) if high - low > 1 else 0
            if high - low > 1 and gain[cut] > best[0]:
                best = (gain[cut], (low, high), low + cut + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    values = np.zeros(size)
    for low, high in leaves:
        values[low:high] = g[low:high].sum() / (h[low:high].sum() + 1)
    return values


def _boost_pair(a, b, size, gradient, hessian):
    """A tree of one cut in each of two features: four quadrants; also its gain."""
    g = np.bincount(a * size + b, gradient, size * size).reshape(size, size).cumsum(0).cumsum(1)
    h = np.bincount(a * size + b, hessian, size * size).reshape(size, size).cumsum(0).cumsum(1)

    def quadrants(s):
        top, side, all_ = s[:, -1:], s[-1:, :], s[-1, -1]
        return np.stack([s, top - s, side - s, all_ - top - side + s])

    qg, qh = quadrants(g), quadrants(h)
    gain = (qg**2 / (qh + 1)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = (qg / (qh + 1))[:, i, j]
    row, column = np.arange(size) > i, np.arange(size) > j
    return value[2 * row[:, None] + column[None, :]], float(gain[i, j])


class AdditiveModel:
    """Lookup tables per feature and per pair; scores by adding bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
        self.tables = np.zeros((len(FEATURES), BINS))
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables = np.zeros((0, BINS, BINS))
        share = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(share / (1 - share)))
        if len(set(y.tolist())) > 1:
            self._fit(self.bins(x), y)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, x[:, k], "left") for k, edges in enumerate(self.edges)], 1)

    def _fit(self, bins, y):
        total = np.full(len(y), self.start)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for k in range(len(FEATURES)):
                step = STEP * np.clip(_boost(bins[:, k], BINS, *slopes()), -4, 4)
                self.tables[k] += step
                total += step[bins[:, k]]
        gains = {(a, b): _boost_pair(bins[:, a], bins[:, b], BINS, *slopes())[1] for a, b in combinations(range(len(FEATURES)), 2)}
        self.pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS]
        self.pair_tables = np.zeros((len(self.pairs), BINS, BINS))
        for _ in range(PAIR_ROUNDS):
            for k, (a, b) in enumerate(self.pairs):
                step = STEP * np.clip(_boost_pair(bins[:, a], bins[:, b], BINS, *slopes())[0], -4, 4)
                self.pair_tables[k] += step
                total += step[bins[:, a], bins[:, b]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = self.start + self.tables[np.arange(len(FEATURES)), bins].sum(1)
        for table, (a, b) in zip(self.pair_tables, self.pairs, strict=True):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Learn from at most `sample_rows` labelled rows that are not held out; no other text is read by Python."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    # At most sample_rows rows of two numbers: small for any corpus.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", _figures("text").alias("features"))
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows).toPandas()
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES))
    return AdditiveModel(x, found["quality"].to_numpy(float))


def scored(rows: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds `score`, in one pass over the texts; no other column passes through Python."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        figures = np.array([features_of(text or "") for text in texts], float)
        return pd.Series(model.score(figures.reshape(len(texts), len(FEATURES))))

    return rows.withColumn("score", score("text"))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = scored(documents.select("doc_id", "text"), fit(documents, labels))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least ACCEPT, unchanged."""
    columns = common.DOCUMENT_COLUMNS
    return scored(documents.select(*columns), fit(documents, labels)).where(F.col("score") >= ACCEPT).select(*columns)
