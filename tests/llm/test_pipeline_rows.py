"""Rows of corpus_pipeline.run against a small corpus whose outcome plain Python knows."""

import collections
import glob
import hashlib
import random
import re

import pytest

import corpus_pipeline
from tendergrid import session

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score int, class_id string, features int"
SOURCES = ["a", "b", None]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    draw = random.Random(7)

    def prose():
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(100)]
        return " ".join(w + "." if i % 12 == 11 else w for i, w in enumerate(words)) + "."

    good = {i: prose() for i in range(1, 61)}
    good |= {i: f"{good[i]} mail ann.lee{i}@example.org from 10.0.{i}.7 today" for i in (3, 4, 5)}
    good |= {70: good[10], 71: good[10]}
    good |= {80 + i: good[20 + i].replace(good[20 + i].split()[50], "changed") for i in range(4)}
    bad = {i: " ".join(draw.choice(["||||", "!!!", "###", "$$|$$"]) + str(draw.randint(0, 999)) for _ in range(90)) for i in range(201, 261)}
    return good, bad


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    good, bad = corpus()
    rows = [(i, text, "en", SOURCES[i % 3], len(text), "k", 1, "c", 2) for i, text in (good | bad).items()]
    rows += [rows[0], (-1, None, None, None, None, None, None, None, None), (-2, "", "en", "a", 0, "k", 1, "c", 2)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i in good)) for i in good | bad if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, good


def test_rows_of_the_pipeline(spark, made):
    folder, good = made
    stage_tables = session.work_folder(spark, "x").rsplit("/", 1)[0] + "/llm-*"
    before = set(glob.glob(stage_tables))
    rows = corpus_pipeline.run(spark, folder).collect()
    left = {path.rsplit("/llm-", 1)[1].rsplit("-", 1)[0] for path in set(glob.glob(stage_tables)) - before}
    assert left == {"pipeline-mixing"}

    kept = {i: text for i, text in good.items() if i <= 60}
    clean = {i: re.sub(r"10\.0\.\d+\.7", "[IP]", re.sub(r"ann\.lee\d+@example\.org", "[EMAIL]", t)) for i, t in kept.items()}
    known = {}
    for i, text in clean.items():
        words = text.split(" ")
        for n in range(1, len(words) + 1):
            known[i, digest(" ".join(words[:n]))] = known[i, digest(" ".join(words[:n]) + " ")] = n
    # Every row is the start of a redacted text of a document that quality and near duplicates left.
    assert all((r.doc_id, r.decoded_sha256) in known for r in rows)
    assert all(r.n_tokens * 4 == len(r.ids) and digest_of(r.ids) == r.ids_sha256 for r in rows)

    taken = collections.Counter()
    for r in rows:
        taken[r.doc_id] += known[r.doc_id, r.decoded_sha256]
    sizes = {i: len(text.split()) for i, text in clean.items()}
    assert all(taken[i] <= 2 * sizes[i] for i in sizes)
    size = {s: sum(n for i, n in sizes.items() if SOURCES[i % 3] == s) for s in SOURCES}
    share = 1.5 * sum(size.values())
    # Weights 3, 1, 2: source a stops at twice its size, the rest goes to the others one to two.
    assert share * 3 / 6 > 2 * size["a"]
    targets = {"a": 2 * size["a"], "b": (share - 2 * size["a"]) / 3, None: (share - 2 * size["a"]) * 2 / 3}
    for source, target in targets.items():
        got = sum(n for i, n in taken.items() if SOURCES[i % 3] == source)
        assert abs(got - target) <= 0.05 * target
    assert all(taken[i] for i in sizes if SOURCES[i % 3] != "b")


def digest_of(data):
    return hashlib.sha256(data).hexdigest()


def test_an_empty_corpus(spark, made, tmp_path):
    folder, _ = made
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
