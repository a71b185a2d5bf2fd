"""Exact duplicates, periodic runs and fill-in-middle against brute force, on whole small tables and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tendergrid.llm import common, content_sort, fill_middle, periodic_runs

SCHEMA = "doc_id long, text string, keep_id string, part int, n string, runs int"
ODD = [
    (-1, None, "x", 1, "y", 2), (-2, "", None, None, None, None), (-3, " \t\n\x0b\x0c\r ", "x", 1, "y", 2),
    (-4, "a\U0001d11e\u0301 <P> $1 \\Q\\E\r\n\u2028x", "x", 1, "y", 2), (-5, "a\U0001d11e\u0301$1 \\E\r\n\u2028\u0085x\u00a0y", "x", 1, "y", 2),
    (-6, "lorem 12 " * 20_000, "x", 1, "y", 2), (-6, "lorem 12 " * 20_000, "x", 1, "y", 2), (-7, "lorem 12 " * 20_000, "x", 1, "y", 2),
    (None, "no number", "x", 1, "y", 2), (None, "no number", "x", 1, "y", 2), (None, None, None, 1, "y", 2), (-8, "no number", "x", 1, "y", 2),
    (-9, "ab " * 23, "x", 1, "y", 2), (-10, "ab " * 24, "x", 1, "y", 2), (-11, " ".join(["a b c d e f g h i"] * 3), "x", 1, "y", 2),
    (-12, "a\x85b a\u00a0b " * 30, "x", 1, "y", 2), (-13, "<S", "x", 1, "y", 2), (-14, "P>" * 9, "x", 1, "y", 2),
]


@pytest.fixture(scope="module")
def documents(spark, tables):
    odd = spark.createDataFrame(ODD, SCHEMA)
    return common.table(spark, tables, "documents").unionByName(odd, allowMissingColumns=True)


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups_of(rows):
    groups = collections.defaultdict(list)
    for number, text in rows:
        groups[text].append(number)
    expected = collections.Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        ids.remove(keep)
        expected[keep, keep, len(ids) + 1, True, sha(text)] += 1
        for number in ids:
            expected[number, keep, len(ids) + 1, False, sha(text)] += 1
    return expected


def test_exact_duplicates(documents, rows):
    assert collections.Counter(map(tuple, content_sort.classify(documents).collect())) == groups_of(rows)
    kept = content_sort.deduplicated(documents)
    assert collections.Counter(r.text for r in kept.collect()) == collections.Counter({t for _, t in rows})


def test_groups_over_many_ranges(spark):
    """Groups far larger than a range, ranges within a group, and texts that differ late or not at all in their beginning."""
    rows = [(i, "same") for i in range(900)] + [(i, "begin " * 20 + str(i % 7)) for i in range(900, 1500)] + [(i, f"t{i}") for i in range(1500, 1600)]
    rows += [(None, "same"), (5, "same"), (899, "same"), (1, None), (2, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = groups_of([(i, t or "") for i, t in rows])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for ranges in ("1", "8", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            assert collections.Counter(map(tuple, content_sort.classify(frame).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_stretches_over_batches(size):
    import pyarrow as pa

    texts = list("aabbbbcddddddde") + ["e"] * 7
    arrow = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()),
                       ("last", pa.bool_()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
    work, made = content_sort._Stretches(arrow, 3, False), []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        made += work.add(pa.RecordBatch.from_pydict({"doc_id": list(range(i, i + len(part))), "text": part, "text_sha256": part}))
    made += work.finish()
    got = [row for batch in made for row in batch.to_pylist()]
    count, last = collections.Counter(texts), {t: i for i, t in enumerate(texts)}
    edge = {texts[0]: 0, texts[-1]: 1}
    assert [tuple(r.values()) for r in got] == [
        (i, t, last[t], count[t], last[t] == i, 3, edge.get(t), t if t in edge and last[t] == i else None) for i, t in enumerate(texts)
    ]


def test_another_normalisation(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, " A"), (2, "a"), (3, "b")], "doc_id long, text string")
    got = content_sort.classify(frame, normalise=lambda c: F.lower(F.trim(c))).collect()
    assert {(r.doc_id, r.keep_id, r.kept, r.text_sha256) for r in got} == {(1, 2, False, sha("a")), (2, 2, True, sha("a")), (3, 3, True, sha("b"))}


def brute_runs(words):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        same = np.concatenate([[0], (words[p:] == words[:-p]).astype(int), [0]])
        change = np.diff(same)
        for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            if b - a + p >= max(24, 3 * p):
                found.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return np.array(b[:n])


def sequences():
    draw = np.random.default_rng(0)
    yield from (np.zeros(n, int) for n in (0, 1, 23, 24, 500))
    yield fibonacci(900)
    yield np.array([i.bit_count() & 1 for i in range(600)])
    yield np.array([i.bit_count() % 3 for i in range(600)])
    yield np.tile([0] * 30 + [1], 40)
    yield np.concatenate([np.r_[np.zeros(24, int), np.arange(6 * i + 1, 6 * i + 7)] for i in range(30)])
    for _ in range(250):
        words = draw.integers(0, draw.integers(1, 6), draw.integers(1, 400))
        for _ in range(draw.integers(0, 4)):
            at, period, length = (int(draw.integers(0, n)) for n in (len(words), 40, len(words)))
            source = words[at : at + period + 1]
            words[at : at + length] = np.resize(source, len(words[at : at + length]))
        yield words


def test_runs_of_sequences():
    documents = list(sequences())
    expected = [brute_runs(words) for words in documents]
    assert sum(map(len, expected)) > 100
    assert [[tuple(run) for run in runs.tolist()] for runs in periodic_runs.find_runs(documents)] == expected
    for words, runs in zip(documents[:40], expected, strict=False):
        for step in (1, 5):
            catchers = periodic_runs.SquareCatchers()
            for i in range(0, len(words), step):
                catchers.append(words[i : i + step], len(words))
            assert [tuple(run) for run in catchers.found().tolist()] == runs


def test_marks_are_forgotten():
    words = np.random.default_rng(1).integers(0, 50, 60_000)
    catchers = periodic_runs.SquareCatchers()
    for i in range(0, len(words), 500):
        catchers.append(words[i : i + 500], 1200)
    assert sum(len(level.values) for level in catchers.levels) < 20_000


def test_periodic_runs(documents, rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    expected = collections.Counter()
    for number, text in rows:
        words = word.findall(text)
        n, h = len(words), zlib.crc32(b"" if number is None else str(number).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        numbers = {}
        runs = brute_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], int))
        best = max(runs, key=lambda r: (r[1] * 1_000_000_007 // r[2], -r[0], -r[2]), default=None)
        drop = {i for start, length, period in runs for i in range(start + period, start + length)}
        collapsed = " ".join(w for i, w in enumerate(words) if i not in drop)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        expected[(number, len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(collapsed))] += 1
    got = periodic_runs.digests(documents)
    assert collections.Counter(map(tuple, got.collect())) == expected
    assert sum(k[1] > 0 for k in expected) > 10


def test_whole_runs_and_texts(spark):
    frame = spark.createDataFrame([(1, "x " + "a b " * 12 + "y"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(run) for run in r.runs], r.collapsed) for r in periodic_runs.collapse(frame).collect()}
    assert got == {1: ([(1, 24, 2)], "x a b y"), 2: ([], "")}


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 7)
    vocabulary = periodic_runs._Vocabulary()
    text = "aé b\u00a0c  longer-than-seven \x1c d\n" * 5
    numbers = vocabulary.numbers(text)
    assert [list(vocabulary)[i].decode() for i in numbers] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_fill_middle(documents, rows):
    got = fill_middle.transform(documents).collect()
    expected, forms = collections.Counter(), collections.Counter()
    for number, text in rows:
        digest = sha("1:" + ("" if number is None else str(number)))
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            form, output = "plain", text
        elif h4 % 100 < 20:
            form, output = "spm", f"<S>{s}<P>{p}<M>{m}"
        else:
            form, output = "psm", f"<P>{p}<S>{s}<M>{m}"
        cut = (None, None) if form == "plain" else (a, b - a)
        expected[(number, text, n, form, *cut, output)] += 1
        forms[form] += 1
    assert collections.Counter(map(tuple, got)) == expected
    assert min(forms.values()) > 5
    digests = collections.Counter((i, n, f, a, b, sha(o), sha(t)) for (i, t, n, f, a, b, o), k in expected.items() for _ in range(k))
    assert collections.Counter(map(tuple, fill_middle.digests(documents).collect())) == digests


def test_other_markers(spark):
    from pyspark.sql import functions as F

    marks = ("[$1\\E", "{Q.", "(*")
    frame = spark.createDataFrame([(i, f"ab{i}\n+d$2") for i in range(50)], "doc_id long, text string")
    made = fill_middle.transform(frame, markers=marks, cut_share=100, spm_share=50)
    back = made.select("text", "output", "form", fill_middle.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r.form for r in back} == {"psm", "spm"} and all(r.back == r.text and all(m in r.output for m in marks) for r in back)
    for wrong in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fill_middle.transform(frame, markers=wrong)


def test_empty_tables(documents):
    nothing = documents.limit(0)
    assert content_sort.classify(nothing).count() == content_sort.deduplicated(nothing).count() == 0
    assert periodic_runs.digests(nothing).count() == fill_middle.digests(nothing).count() == 0


def test_plans_without_python_or_shuffle(documents, capsys):
    fill_middle.digests(documents).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
