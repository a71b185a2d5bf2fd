r"""Runs of periodically repeated words, found online by square catchers over dyadic blocks.

A text is a sequence of words. Each time a block of L = 1, 2, 4, ... words is
complete it gets a catcher, which lives for the next 4 L words: it watches for
its block to come again at a distance p of 2 L to 4 L words (level 0: 1 to 3).
Each appended word ends one suffix of every length L, and that suffix is
compared, by a 64-bit mark built from those of its halves, with the two live
catchers of its level. A square of period p contains three neighbouring blocks
that all come again at distance p, so the third catch in a row reports a new
square, unless it lies within a run already known whose period divides p. The
report is checked word by word and widened to the left by less than L words; to
the right it grows with the words appended. What has grown past three periods is
a run; squares of one run with multiples of its period cover the same words and
merge into the smallest period. All of it takes n log n steps.

Words appended together are handled by array operations, but any division of a
text into appends finds the same runs (tested with one word at a time). Reports
are checked on the words themselves; a mark that equals another by chance could
hide a run with a probability below n / 2^60.

Marks are kept for the last 16 L words of a level and only for levels a document
is long enough for, so memory is a few numbers per word of the longest document.
Documents of a batch share one stream, longest first, each closed by a word of
its own that never comes again.

Null text counts as empty; a text without words has no runs and collapses to the
empty text. Repeated rows each get their result, an empty table gives an empty
result, and only doc_id and the text column are read.
"""

import collections
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
# A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# Words appended at a time, bytes of text split at a time, texts and bytes per stream.
APPENDED, PIECE, STREAM_TEXTS, STREAM_BYTES = 1 << 18, 1 << 22, 2_000, 1 << 24

RUNS = T.ArrayType(
    T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")]), False
)
_FACTORS = np.random.default_rng(12).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(marks: np.ndarray) -> np.ndarray:
    marks ^= marks >> np.uint64(29)
    marks *= np.uint64(0xBF58476D1CE4E5B9)
    marks ^= marks >> np.uint64(32)
    return marks


class _Tail:
    """The latest entries of an endless array, by their absolute place."""

    def __init__(self, kind):
        self.base, self.values = 0, np.empty(0, kind)

    @property
    def end(self) -> int:
        return self.base + len(self.values)

    def add(self, more: np.ndarray) -> None:
        self.values = np.concatenate([self.values, more])

    def trim(self, n: int) -> None:
        """Forget all but the last n entries, now and then."""
        if len(self.values) > 2 * n:
            self.base += len(self.values) - n
            self.values = self.values[-n:].copy()

    def at(self, places) -> np.ndarray:
        return self.values[places - self.base]


class SquareCatchers:
    """Words appended so far, the catchers over them and the runs found."""

    def __init__(self):
        self.size = 0
        self.words = np.empty(0, np.int64)
        # The run that covers a word, of several that of the smallest period, and that period.
        self.cover, self.cover_period = np.empty(0, np.int32), np.empty(0, np.int64)
        self.levels: list[_Tail] = []
        # Rows of start, end, period; the first n_runs are in use.
        self.runs, self.n_runs = np.empty((0, 3), np.int64), 0
        self.growing: list[int] = []

    def _store(self, words: np.ndarray) -> None:
        need = self.size + len(words)
        if need > len(self.words):
            more = max(need, 2 * len(self.words)) - self.size
            self.words = np.concatenate([self.words[: self.size], np.empty(more, np.int64)])
            self.cover = np.concatenate([self.cover[: self.size], np.full(more, -1, np.int32)])
            self.cover_period = np.concatenate([self.cover_period[: self.size], np.full(more, 1 << 62)])
        self.words[self.size : need] = words
        self.size = need

    def append(self, words: np.ndarray, longest: int) -> None:
        """Take further words; no document that is still open or yet to come has more than `longest`, which never rises."""
        self._store(words)
        for number in self.growing:
            self._grow(number)
        level, length = 0, 1
        lower = None
        while level == 0 or 2 * LEAST_PERIODS * length <= longest:
            if level == len(self.levels):
                self.levels.append(_Tail(np.uint64))
            marks = self.levels[level]
            seen = marks.end
            if level == 0:
                marks.add(_mixed(words.astype(np.uint64) * _FACTORS[0] + np.uint64(1)))
            elif self.size - length >= seen:
                ends = np.array([seen, self.size - length + 1]) - lower.base
                left, right = lower.values[slice(*ends)], lower.values[slice(*(ends + length // 2))]
                marks.add(_mixed(left * _FACTORS[level] + right))
            self._catch(marks, seen, length)
            lower = marks
            level, length = level + 1, 2 * length
        for number, marks in enumerate(self.levels[:level]):
            marks.trim(8 << number)
        self.growing = [number for number in self.growing if self.runs[number, 1] == self.size]

    def _catch(self, marks: _Tail, seen: int, length: int) -> None:
        """Compare the new suffixes of a level with its live catchers."""
        for back in (1, 2, 3) if length == 1 else (2, 3):
            # Suffixes that begin in row r of the blocks are compared with block r - back.
            start = max(seen, back * length)
            if start >= marks.end:
                continue
            rows = np.arange(start // length, (marks.end - 1) // length + 1)
            inside = np.minimum((rows + 1) * length, marks.end) - np.maximum(rows * length, start)
            heads = np.repeat(marks.at((rows - back) * length), inside)
            at = np.flatnonzero(marks.values[start - marks.base :] == heads) + start
            if len(at):
                self._report(marks, at, (at // length - back) * length, length)

    def _report(self, marks: _Tail, at: np.ndarray, block: np.ndarray, length: int) -> None:
        """Keep each third catch in a row and check it, unless a known run explains it."""
        for step, wanted in ((1, True), (2, True), (3, False)):
            there = block >= step * length
            before = np.where(there, block - step * length, block)
            again = np.where(there, at - step * length, at)
            same = there & (marks.at(before) == marks.at(again))
            kept = same if wanted else ~same
            at, block = at[kept], block[kept]
        if not len(at):
            return
        period, start, end = at - block, block - 2 * length, at + length
        known = np.zeros(len(at), bool)
        if self.n_runs:
            for place in (start, block, at):
                run = self.cover[place]
                low, high, base = self.runs[run].T
                known |= (run >= 0) & (low <= start) & (high >= end) & (period % np.maximum(base, 1) == 0)
        for s, e, p in zip(start[~known].tolist(), end[~known].tolist(), period[~known].tolist(), strict=True):
            self._found(s, e, p, length)

    def _found(self, start: int, end: int, period: int, length: int) -> None:
        words = self.words
        if not np.array_equal(words[start : end - period], words[start + period : end]):
            return
        low = max(0, start - length)
        differ = np.flatnonzero(words[low:start] != words[low + period : start + period])
        start = low + int(differ[-1]) + 1 if len(differ) else low
        number = self.n_runs
        if number == len(self.runs):
            self.runs = np.concatenate([self.runs, np.zeros((max(64, number), 3), np.int64)])
        self.runs[number] = start, end, period
        self.n_runs += 1
        self._paint(number, start, end)
        self._grow(number)
        self.growing.append(number)

    def _grow(self, number: int) -> None:
        """Widen a run by the words appended since, as far as they repeat."""
        _, end, period = self.runs[number].tolist()
        done, step = end, 64
        while done < self.size:
            upto = min(done + step, self.size)
            differ = np.flatnonzero(self.words[done:upto] != self.words[done - period : upto - period])
            if len(differ):
                done += int(differ[0])
                break
            done, step = upto, 2 * step
        self.runs[number, 1] = done
        self._paint(number, end, done)

    def _paint(self, number: int, start: int, end: int) -> None:
        period = self.runs[number, 2]
        larger = self.cover_period[start:end] > period
        self.cover[start:end][larger] = number
        self.cover_period[start:end][larger] = period

    def found(self, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
        """Rows of (start, length, period), by start, then period; of equal stretches the smallest period."""
        smallest = {}
        for start, end, period in self.runs[: self.n_runs].tolist():
            if end - start >= max(least_words, least_periods * period):
                smallest[start, end] = min(period, smallest.get((start, end), period))
        return np.array(sorted((s, e - s, p) for (s, e), p in smallest.items()), np.int64).reshape(-1, 3)


class _Vocabulary(dict):
    """Numbers for words, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, text: str) -> np.ndarray:
        """The words of a text; bytes.split() parts at exactly the six characters that no word holds."""
        data, found, start = text.encode(), [], 0
        while start < len(data):
            end = start + PIECE
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            words = data[start:end].split()
            found.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            start = end
        return np.concatenate(found) if found else np.empty(0, np.int64)


def find_runs(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each document, given as word numbers from 0 on."""
    catchers = SquareCatchers()
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    starts, at = {}, 0
    waiting, size, longest = [], 0, 0

    def flush():
        stream = np.concatenate(waiting)
        for piece in range(0, len(stream), APPENDED):
            catchers.append(stream[piece : piece + APPENDED], longest)
        waiting.clear()

    for number in order:
        if not waiting:
            longest, size = len(documents[number]), 0
        starts[number] = at
        waiting += [documents[number], np.array([-1 - number])]
        at += len(documents[number]) + 1
        size += len(documents[number]) + 1
        if size >= APPENDED:
            flush()
    if waiting:
        flush()
    runs = catchers.found()
    results = [runs[:0]] * len(documents)
    for number, start in starts.items():
        low, high = np.searchsorted(runs[:, 0], [start, start + len(documents[number])])
        if high > low:
            results[number] = runs[low:high] - [start, 0, 0]
    return results


def collapsed_words(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The words that no run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return words[keep]


def _joined(words: np.ndarray, spellings: list[bytes]) -> bytes:
    parts = (words[i : i + APPENDED].tolist() for i in range(0, len(words), APPENDED))
    return b" ".join(b" ".join(map(spellings.__getitem__, part)) for part in parts)


def _streams(texts: pa.Array):
    """Slices of a batch that are small enough to be held as one stream; one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += text.as_buffer().size if text.is_valid else 0
        if held >= STREAM_BYTES or i + 1 - start >= STREAM_TEXTS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def collapse(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of every row."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    struct = pa.struct([pa.field(name, pa.int64(), False) for name in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            for low, high in _streams(batch.column(1)):
                vocabulary = _Vocabulary()
                texts = batch.column(1).slice(low, high - low)
                words = [vocabulary.numbers(value.as_py() or "") for value in texts]
                runs = find_runs(words)
                spellings = list(vocabulary)
                flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(each) for each in runs])]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(column) for column in flat.T], fields=list(struct))
                kept = [_joined(collapsed_words(w, r), spellings).decode() for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(kept, pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    return documents.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def tiled(doc_id: Column, text: Column, words: Column) -> Column:
    """The text with its end repeated for one document in ten, as the query's contract lays down."""
    hashed = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    n = F.greatest(F.size(words).cast("bigint"), F.lit(1))
    group = F.floor(hashed / 10).cast("bigint")
    start = group % n
    period = 1 + F.floor((n - start) / (3 + group % 8)).cast("bigint")
    repeated = F.transform(words, lambda word, i: F.when(i < start, word).otherwise(F.get(words, (start + (i - start) % period).cast("int"))))
    return F.when(F.size(words) > 0, F.array_join(repeated, " ")).otherwise(text)


def _greatest(runs: Column) -> Column:
    """The run of the greatest length by period, then smallest start and period; null if there is none."""

    def order(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(
            F.signum(a["period"] - b["period"]).cast("int")
        )

    return F.get(F.array_sort(runs, order), F.lit(0))


def digests(documents: DataFrame) -> DataFrame:
    """Per row of documents with planted repetitions: number of runs, the greatest one, digests of runs and collapsed text."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    split = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    no_words = F.array().cast("array<string>")
    rows = documents.select("doc_id", "text", F.when(hashed % 10 == 0, split).otherwise(no_words).alias("words"))
    rows = rows.select("doc_id", tiled(F.col("doc_id"), F.col("text"), F.col("words")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = collapse(rows).select("*", _greatest(F.col("runs")).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
