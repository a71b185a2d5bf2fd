"""Secrets: a character convolutional network over every candidate and its surroundings.

Strict patterns give the base findings, which always stay. Further candidates
are: runs of at least MIN_RUN key characters that hold a digit or change case
inside a word; whatever of at least LEAST_VALUE characters follows `=` or `:`,
quoted or not, plain words included; and base matches that fail their length
rule. Outside such a position a run of letters alone is a word, not a candidate.

The network (one convolution, maximum over the positions, one logistic unit;
plain numpy) is trained on all labelled findings, copies once. Positive are
the base findings: as they stand, their values without the telling name before
them, and keys drawn anew in their alphabets and lengths down to LEAST_VALUE.
Negative is prose, a word of every text that has room for one: words as they
stand, after `:` and `=`, and hard negatives made of those words: identifiers,
paths, file names, dates, versions, long numbers. Failing matches are not
labelled: the network decides about them. Findings are dealt by hash into groups
of about GROUP_ROWS; in each round every group trains the common weights on its
own findings, and the mean over the groups, by their findings, is the next
common state. One finding in four is held out. Scores are calibrated by Platt's
method on counts of all held-out ones, copies counted, by logit in steps of
1/LOGIT_STEPS; the threshold is the highest such step that still finds RECALL of
them; there is no floor under it.
Every candidate is scored, base findings too. Candidates at or above the
threshold that overlap no base finding and no better one are added as `key`.

Whole texts are searched once, where they lie; what is kept of them is narrow
and staged. A candidate longer than the window is scored piece by piece and
counts with its best piece. Null text counts as empty and has no findings;
repeated rows each get theirs; an empty table gives an empty result. Without
findings the network learns from the drawn keys alone. Only doc_id and text are
read, so further columns cannot clash. Offsets are code points, ends exclusive.
"""

import bisect
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendergrid.llm import common

KINDS = ["assign", "access", "hex", "key"]
GROUP_ROWS, ROUNDS = 4_096, 4
LOGIT_STEPS, LOGIT_LIMIT = 256, 32
MIN_RUN, LEAST_VALUE = 8, 6
RECALL = 0.99
BEFORE, INSIDE, AFTER = 24, 64, 8
WINDOW = BEFORE + INSIDE + AFTER
WIDTH, FILTERS, STEPS, BATCH = 5, 24, 600, 128

# Fixed patterns of the base rules; letters of the first are ASCII in either case.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Whole runs; those of HEX_LEAST are findings, shorter ones failing matches.
HEX, HEX_LEAST = re.compile(r"[0-9a-f]{8,}"), 24
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
VALUE = re.compile(rf"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]{{{LEAST_VALUE},}})""")
WORD = re.compile(r"[^\s]+")

FOUND = "array<struct<kind:string,start:int,end:int,base:boolean,label:int,before:string,inside:string,after:string>>"


def candidates(text: str, number: int) -> list[dict]:
    """Base findings (label 1), a word of prose (label 0), all other candidates (no label)."""
    found, places = [], set()

    def add(kind, start, end, base, label):
        if kind == "key" and (start, end) in places:
            return
        places.add((start, end))
        found.append(
            {"kind": kind, "start": start, "end": end, "base": base, "label": label,
             "before": text[max(start - BEFORE, 0) : start], "inside": text[start:end], "after": text[end : end + AFTER]}
        )

    folded = text.lower()
    if any(word in folded for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        for m in ASSIGN.finditer(text):
            good = len(m[1]) >= 6
            add("assign" if good else "key", m.start(), m.end(), good, 1 if good else None)
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            good = len(m[0]) >= 20
            add("access" if good else "key", m.start(), m.end(), good, 1 if good else None)
    for m in HEX.finditer(text):
        size = m.end() - m.start()
        good = size >= HEX_LEAST
        add("hex" if good else "key", m.start(), m.end(), good, 1 if good else None)
    for m in RUN.finditer(text):
        if not m[0].islower() or not m[0].isalpha():
            if MIXED.search(m[0]):
                add("key", m.start(), m.end(), False, None)
    for m in VALUE.finditer(text):
        add("key", m.start(1), m.end(1), False, None)
    # Prose to tell findings from: one word of the text.
    draw = random.Random(number)
    if len(text) > 60:
        m = WORD.search(text, draw.randrange(len(text) - 40))
        if m and not any(f["start"] < m.end() and m.start() < f["end"] for f in found):
            add("prose", m.start(), m.end(), False, 0)
    return found


def findings(documents: DataFrame) -> DataFrame:
    """doc_id and `found` of every row."""

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([candidates(t or "", int(n)) for t, n in zip(texts, numbers, strict=True)], dtype=object)

    return documents.select("doc_id", search("text", F.xxhash64("doc_id", F.length("text"))).alias("found"))


_CLASS = np.zeros(128, np.int64)
for _number, _members in enumerate(
    ["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "_-", "+/", "=", ".", "\"'", ":", " \n\t", "@", "aeiou"], 1
):
    for _member in _members:
        _CLASS[ord(_member)] = _number
_CLASSES = 16
_CHANNELS = _CLASSES + 1


def _windows(before: str, inside: str, after: str) -> list[np.ndarray]:
    """Character classes of each piece of a candidate with its surroundings; 0 is padding, 15 other characters."""

    def classes(text):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(points < 128, _CLASS[np.minimum(points, 127)], 15)

    lead, tail = classes(before[-BEFORE:]), classes(after[:AFTER])
    rows = []
    for at in range(0, max(len(inside), 1), INSIDE):
        piece = classes(inside[at : at + INSIDE])
        row = np.zeros(WINDOW, np.int64)
        row[BEFORE - len(lead) : BEFORE] = lead
        row[BEFORE : BEFORE + len(piece)] = piece
        row[BEFORE + len(piece) : BEFORE + len(piece) + len(tail)] = tail
        rows.append(row)
    return rows


# What training changes, in the order of `CharNetwork.weights`.
_LEARNED = ["filters", "bias", "out", "shift"]


class CharNetwork:
    """Convolution over one-hot characters, maximum over positions, one logistic unit; trained by Adam."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.filters = draw.normal(0, 0.2, (WIDTH * _CHANNELS, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = draw.normal(0, 0.2, FILTERS)
        self.shift = np.zeros(1)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 2.0
        self.held_out = {}

    def _patches(self, rows: np.ndarray) -> np.ndarray:
        hot = np.zeros((*rows.shape, _CHANNELS))
        np.put_along_axis(hot, rows[..., None], 1, 2)
        hot[:, BEFORE : BEFORE + INSIDE, -1] = 1
        cut = np.lib.stride_tricks.sliding_window_view(hot, WIDTH, axis=1)
        return cut.transpose(0, 1, 3, 2).reshape(len(rows), WINDOW - WIDTH + 1, -1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        found = [
            np.maximum((self._patches(rows[i : i + 256]) @ self.filters + self.bias).max(1), 0) @ self.out + self.shift
            for i in range(0, len(rows), 256)
        ]
        return np.concatenate(found) if found else np.zeros(0)

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in _LEARNED])

    def take(self, weights: np.ndarray) -> "CharNetwork":
        at = 0
        for n in _LEARNED:
            shape, size = getattr(self, n).shape, getattr(self, n).size
            setattr(self, n, weights[at : at + size].reshape(shape))
            at += size
        return self

    def train(self, rows: np.ndarray, labels: np.ndarray, steps: int, seed: int = 7) -> None:
        """`steps` batches, or as many as take every row once."""
        draw, size = np.random.default_rng(seed), min(BATCH, len(rows))
        steps = max(steps, -(-len(rows) // size))
        passes = -(-steps * size // len(rows))
        order = np.concatenate([draw.permutation(len(rows)) for _ in range(passes)])
        first = {n: np.zeros_like(getattr(self, n)) for n in _LEARNED}
        second = {n: np.zeros_like(getattr(self, n)) for n in _LEARNED}
        for step in range(1, steps + 1):
            chosen = order[(step - 1) * size : step * size]
            patches, y = self._patches(rows[chosen]), labels[chosen]
            heard = patches @ self.filters + self.bias
            where = heard.argmax(1)
            top = np.take_along_axis(heard, where[:, None, :], 1)[:, 0]
            live = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-(live @ self.out + self.shift))) - y) / len(chosen)
            back = error[:, None] * self.out * (top > 0)
            picked = patches[np.arange(len(chosen))[:, None], where]
            slopes = {
                "filters": np.einsum("bfi,bf->if", picked, back),
                "bias": back.sum(0),
                "out": live.T @ error,
                "shift": error.sum(keepdims=True),
            }
            for n in _LEARNED:
                first[n] = 0.9 * first[n] + 0.1 * slopes[n]
                second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(self, n, getattr(self, n) - 0.01 * move)

    def calibrate(self, z: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by gradient steps, then the highest of the logits that keeps the recall; counts say how often each comes."""
        share = counts / counts.sum()
        for _ in range(200):
            error = 1 / (1 + np.exp(-(self.slope * z + self.offset))) - labels
            self.slope -= 0.05 * float(share @ (error * z))
            self.offset -= 0.05 * float(share @ error)
        order = np.argsort(z[labels == 1])
        wanted, often = z[labels == 1][order], counts[labels == 1][order]
        below = np.cumsum(often) - often
        self.threshold = float(self._score(wanted[below <= (1 - recall) * often.sum()])[-1])
        taken = self._score(z) >= self.threshold
        self.held_out = {
            "findings": int(counts @ labels),
            "others": int(counts @ (1 - labels)),
            "recall": float(counts @ (labels * taken) / (counts @ labels)),
            "precision": float(counts @ (labels * taken) / (counts @ taken)),
            "threshold": self.threshold,
        }

    def _score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return self._score(self.logits(rows))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
# Alphabets of drawn keys: hexadecimal, lower and upper case with digits, mixed, base64.
_ALPHABETS = ["abcdef" + _DIGITS, _LETTERS + _DIGITS, _LETTERS.upper() + _DIGITS, _LETTERS + _LETTERS.upper() + _DIGITS,
              _LETTERS + _LETTERS.upper() + _DIGITS + "+/"]
_NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey", "key", "auth", "credential"]


def _drawn_key(draw: random.Random, least: int, most: int) -> str:
    letters = draw.choice(_ALPHABETS)
    key = "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))
    if draw.random() < 0.3:
        key = "".join(draw.choice(_LETTERS) for _ in range(draw.randint(2, 4))) + draw.choice("_-") + key
    return key


def _positives(rows: list[tuple], prose: list[tuple], draw: random.Random) -> list[tuple]:
    """Findings as they stand, their values among prose, and keys drawn anew, named or among prose."""
    made = []
    for before, inside, after in rows:
        made.append((before, inside, after))
        named = ASSIGN.match(inside)
        lead, _, tail = draw.choice(prose)
        made.append((lead, named[1] if named else inside, tail))
        lead, _, tail = draw.choice(prose)
        made.append((lead, _drawn_key(draw, 12, 48), tail))
        quote = draw.choice(["", '"', "'"])
        name = draw.choice(_NAMES) + draw.choice(["=", ": ", ":", " = "]) + quote
        made.append(((lead + name)[-BEFORE:], _drawn_key(draw, LEAST_VALUE, 24), quote + tail))
    return made


def _negatives(prose: list[tuple], draw: random.Random) -> list[tuple]:
    """Words as they stand, as plain values, and what is made of words and numbers in ordinary writing."""
    made = []
    words = [inside.strip(".,;:!?()\"'|") or "word" for _, inside, _ in prose]

    def number(low, high):
        return "".join(draw.choice(_DIGITS) for _ in range(draw.randint(low, high)))

    for before, inside, after in prose:
        made.append((before, inside, after))
        a, b, c = (draw.choice(words)[:16] for _ in range(3))
        made.append(((before + draw.choice([": ", "= ", ":"]))[-BEFORE:], a + draw.choice(["", "-" + b]), after))
        hard = [
            f"{a}_{b}", f"{a}-{b}-{c}", f"{a}/{b}/{c}.txt", f"{a}{number(1, 4)}", a + b.capitalize() + c.capitalize(),
            f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}", f"{number(1, 2)}.{number(1, 2)}.{number(1, 3)}-{a}",
            number(8, 12), f"{number(3, 4)}-{number(3, 4)}-{number(4, 4)}", f"//www.{a}.org/{b}/{number(1, 4)}", f"{a}-{number(1, 6)}",
        ]
        made.append((before, draw.choice(hard), after))
        made.append((before, draw.choice(hard), after))
    return made


# A neighbourhood for drawn keys where a table has no prose.
_PLAIN = [("it was written in the ", "chapter", " of the"), ("see also the ", "numbers", ", where")]


def _labelled(found: DataFrame) -> DataFrame:
    """Every labelled finding with how often it comes, and its group; a row without a label stands for each group.

    Findings of any length: a row keeps one window of each, so groups are bounded in bytes too.
    """
    each = found.select(F.explode("found").alias("f")).where("f.label IS NOT NULL").select("f.*")
    names = ["label", "before", "inside", "after"]
    rows = each.select("label", "before", F.substring("inside", 1, INSIDE).alias("inside"), "after")
    rows = common.staged(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "secrets-labelled")
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    marks = rows.sparkSession.range(groups).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.col("id").alias("part"))
    return rows.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(groups))).unionByName(marks)


def _coded(rows: pd.DataFrame) -> pd.DataFrame:
    """Training and held-out windows of a group, the held-out ones with their counts."""
    part, made = int(rows["part"].iloc[0]), []
    rows = rows[rows["label"].notna()].sort_values(["label", "before", "inside", "after"])
    sample = {
        label: list(rows.loc[rows["label"] == label, ["before", "inside", "after", "n"]].itertuples(index=False, name=None)) for label in (0, 1)
    }
    draw = random.Random(part)
    # Where findings are few, drawn keys make up the number.
    drawn = [("", _drawn_key(draw, 16, 48), "", 1) for _ in range(max(0, 200 - len(sample[1])))]
    for aside in (False, True):
        prose = [row for i, row in enumerate(sample[0]) if (i % 4 == 0) == aside] or [(*row, 1) for row in _PLAIN]
        keys = [row for i, row in enumerate(sample[1] + drawn) if (i % 4 == 0) == aside]
        prose = prose * (1 + 100 // len(prose))
        good = _positives([row[:3] for row in keys], [row[:3] for row in prose], draw)
        bad = _negatives([row[:3] for row in prose], draw)
        # Either makes four examples of a row.
        counts = np.repeat([int(row[3]) for row in keys + prose], 4)
        coded = np.stack([_windows(*row)[0] for row in good + bad]).astype(np.uint8)
        labels = np.repeat([1, 0], [len(good), len(bad)]).astype(np.uint8)
        made.append((part, aside, len(rows) + len(drawn), coded.tobytes(), labels.tobytes(), counts.astype(np.int64).tobytes()))
    return pd.DataFrame(made, columns=["part", "aside", "size", "windows", "labels", "counts"])


def _windows_of(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.windows, np.uint8).reshape(-1, WINDOW).astype(np.int64), np.frombuffer(row.labels, np.uint8).astype(float)


def _round(groups: DataFrame, weights: np.ndarray, number: int) -> np.ndarray:
    """The mean of what every group makes of the common weights, by its size. Decimals add up the same in any order."""

    def learn(batches):
        for batch in batches:
            for row in batch.itertuples():
                network = CharNetwork().take(weights.copy())
                network.train(*_windows_of(row), STEPS // ROUNDS, ROUNDS * row.part + number)
                yield pd.DataFrame({"at": np.arange(len(weights)), "weight": network.weights(), "size": row.size})

    learnt = groups.where("NOT aside").mapInPandas(learn, "at int, weight double, size long")
    size = F.col("size").cast("decimal(18,0)")
    mean = F.sum(F.col("weight").cast("decimal(18,12)") * size).cast("double") / F.sum(size).cast("double")
    # One row per weight of the network.
    return np.array([row["mean"] for row in learnt.groupBy("at").agg(mean.alias("mean")).orderBy("at").collect()])


def fit(found: DataFrame) -> CharNetwork:
    """Train and calibrate on all labelled findings, group by group."""
    groups = _labelled(found).groupBy("part").applyInPandas(
        _coded, "part long, aside boolean, size long, windows binary, labels binary, counts binary"
    )
    groups = common.staged(groups, "secrets-windows")
    network = CharNetwork()
    for number in range(ROUNDS):
        network.take(_round(groups, network.weights(), number))

    def heard(batches):
        for batch in batches:
            for row in batch.itertuples():
                windows, labels = _windows_of(row)
                steps = np.floor(np.clip(network.logits(windows), -LOGIT_LIMIT, LOGIT_LIMIT) * LOGIT_STEPS).astype(int)
                yield pd.DataFrame({"step": steps, "label": labels.astype(int), "n": np.frombuffer(row.counts, np.int64)})

    counted = groups.where("aside").mapInPandas(heard, "step int, label int, n long").groupBy("step", "label").agg(F.sum("n").alias("n"))
    # At most two rows per step of the logit.
    z, labels, counts = np.array([tuple(row) for row in counted.orderBy("step", "label").collect()], float).T
    network.calibrate(z / LOGIT_STEPS, labels, counts)
    return network


def decided(found: DataFrame, network: CharNetwork) -> DataFrame:
    """doc_id, `spans` (base findings and the candidates the network accepts, by start, then kind, each with
    its score) and the number of candidates scored."""

    @F.pandas_udf("scored int, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    def decide(rows: pd.Series) -> pd.DataFrame:
        places, windows = [], []
        for i, each in enumerate(rows):
            for j, f in enumerate(each):
                if f["kind"] != "prose":
                    for window in _windows(f["before"], f["inside"], f["after"]):
                        places.append((i, j))
                        windows.append(window)
        best = {}
        if windows:
            for place, score in zip(places, network.probability(np.stack(windows)).tolist(), strict=True):
                best[place] = max(score, best.get(place, 0.0))
        scored, spans = [], []
        for i, each in enumerate(rows):
            mine = [f | {"score": best[i, j]} for j, f in enumerate(each) if (i, j) in best]
            kept = [f for f in mine if f["base"]]
            ends = sorted((f["start"], f["end"]) for f in kept)
            for f in sorted((f for f in mine if not f["base"]), key=lambda f: (-f["score"], f["start"], f["end"])):
                if f["score"] >= network.threshold and _free(ends, f["start"], f["end"]):
                    bisect.insort(ends, (f["start"], f["end"]))
                    kept.append(f)
            kept.sort(key=lambda f: (f["start"], KINDS.index(f["kind"])))
            scored.append(len(mine))
            spans.append([{k: f[k] for k in ("kind", "start", "end", "base", "score")} for f in kept])
        return pd.DataFrame({"scored": scored, "spans": pd.Series(spans, dtype=object)})

    return found.select("doc_id", decide("found").alias("made")).select("doc_id", "made.*")


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether no span taken overlaps; base spans of different kinds may overlap each other."""
    before = taken[: bisect.bisect_left(taken, (end, 0))]
    return max((e for _, e in before), default=0) <= start


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans, and the scores of the spans and number of candidates scored."""
    found = common.staged(findings(documents), "secrets")
    rows = decided(found, fit(found))
    joined = "array_join(transform({}, c -> concat_ws(':', c.kind, c.start, c.end)), ',')"
    counts = [
        F.expr(f"cast(size(filter(spans, c -> c.base AND c.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS[:3]
    ]
    return rows.select(
        "doc_id",
        *counts,
        F.expr(f"sha2({joined.format('filter(spans, c -> c.base)')}, 256)").alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, c -> NOT c.base)) AS bigint)").alias("n_key"),
        F.col("scored").cast("bigint").alias("n_scored"),
        F.expr("array_join(transform(spans, c -> format_number(c.score, 4)), ',')").alias("scores"),
    )
