"""Archives, URLs and vectors against brute force; the pipeline end to end."""

import collections
import hashlib
import io
import math
import zipfile

import numpy as np
import pytest

import corpus_pipeline
from tendergrid.llm import common, topk, url_filter, warc


class Buffer:
    def __init__(self, data):
        self.data = data

    def read_at(self, length, offset):
        return self.data[offset : offset + length]


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(zip64):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, zip64)
    writer.add("a", [b"12", b"345"])
    writer.add("b/c", [])
    writer.close()
    data = out.getvalue()
    found = warc.members(Buffer(data), len(data))
    assert {n: data[s : s + size] for n, (s, size) in found.items()} == {"a": b"12345", "b/c": b""}
    assert zipfile.ZipFile(io.BytesIO(data)).read("a") == b"12345"


def test_foreign_archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("x", b"abc")
        archive.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    start, size = warc.members(Buffer(data), len(data))["x"]
    assert data[start : start + size] == b"abc"
    with pytest.raises(ValueError):
        warc.members(Buffer(b"no archive"), 10)


def test_round_trip(spark, tables):
    page = "y" * 1500
    odd = [(-1, "u", page), (-2, None, page), (-3, "u\nv", page), (-4, "u", None), (-5, "u", ""), (None, "q", page), (-6, "u", "é" * 499)]
    pages = common.table(spark, tables, "pages").unionByName(
        spark.createDataFrame([(*r, 0) for r in odd], "page_id long, url string, html string, payload_bytes int"), allowMissingColumns=True
    )
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = collections.defaultdict(lambda: None)
    for number, data in rows:
        if number is not None and (last[data] is None or number > last[data]):
            last[data] = number
    expected = collections.Counter()
    for number, data in rows:
        revisit = len(data) >= 1000 and number != last[data]
        expected[(number, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                  last[data] if revisit else None, None if revisit else True)] += 1
    assert collections.Counter(tuple(r) for r in warc.round_trip(pages).collect()) == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_urls(spark, tables):
    odd = [(-1, None), (-2, "no scheme"), (-3, "HTTP://WWW.Example.NET"), (-4, "http://example.net/en/?x"), (-5, "http://a.org?/fr/"),
           (-6, "http://X.org/fr/a#b"), (-7, "http://notexample.com/de/x"), (-8, "h://" + "a" * 50_000)]
    pages = common.table(spark, tables, "pages").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        rest = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
        fits = [(h + p, k) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, got[r.page_id].verdict))
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule, got[r.page_id].verdict) == (host, path, rule, verdict)
        assert got[r.page_id].verdict in ("allow", "block") and math.isfinite(got[r.page_id].score)
    # The models tell apart what the rules taught them.
    ruled = [r for r in got.values() if r.rule]
    allowed = [r.score for r in ruled if r.verdict == "allow"]
    blocked = [r.score for r in ruled if r.verdict == "block"]
    assert np.mean(allowed) > np.mean(blocked)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_models_are_distributions():
    import pandas as pd

    code, _ = url_filter._codes(["http://abc.example/x", "zzz"])
    table = pd.DataFrame({"ruled": "allow", "code": code, "n": 1})
    ratio = url_filter.log_ratio(pd.concat([table, table.assign(ruled="block")]))
    assert np.abs(ratio).max() < 1e-6


def brute_top_k(rows):
    """Every row that takes part, in whole numbers of any size; each row with a fitting id is a query."""
    good = [
        (r.vec_id, [math.floor(256 * float(x)) for x in r.embedding])
        for r in rows
        if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)
    ]
    found = collections.Counter()
    full = np.array([v for _, v in good], object)
    for i, (number, _) in enumerate(good):
        if number % 50 == 0:
            scores = full @ full[i]
            order = sorted((j for j in range(len(good)) if j != i), key=lambda j: (-scores[j], good[j][0]))[:5]
            for rank, j in enumerate(order, 1):
                found[number, rank, good[j][0], int(scores[j])] += 1
    return found


def found_top_k(rows, **settings):
    if not settings:
        return collections.Counter(tuple(r) for r in topk.search(rows).collect())
    vectors = topk.numbered(topk.usable(rows), "test-vectors")
    met = topk.nearest(vectors.where("vec_id % 50 = 0"), vectors, **settings)
    return collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in met.collect())


def test_top_k(spark, tables):
    embeddings = common.table(spark, tables, "embeddings").select("vec_id", "embedding", "label")
    size = len(embeddings.head().embedding)
    same = [0.5] * size
    odd = [(100_000, same), (100_001, same), (100_002, same), (100_050, [float("nan")] * size), (100_100, None), (100_150, []),
           (100_200, [1e6] * size), (None, same), (100_250, [0.1, None]), (100_000, same), (100_003, same)]
    more = spark.createDataFrame(odd, "vec_id long, embedding array<float>").selectExpr("*", "7 AS label", "'x' AS row", "1 AS score", "2 AS v")
    rows = embeddings.unionByName(more, allowMissingColumns=True)
    expected = brute_top_k(rows.collect())
    assert found_top_k(rows) == expected
    assert found_top_k(rows, group=3, block=16) == expected
    few = rows.where("vec_id in (100000, 100001)")
    assert found_top_k(few) == brute_top_k(few.collect())
    assert topk.search(rows.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """One component far beyond the others: only scores that are wanted must fit."""
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(120)]
    rows[50] = (50, [1e10, 0.0, 0.0, 0.0, 0.0, 1.0])
    rows[70] = (70, [-3e9, 2e9, 0.0, 0.0, 0.0, 1.0])
    rows[71] = (71, [2.0**40, 0.0, 1e7])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = frame.where("vec_id <> 71")
    assert found_top_k(kept) == brute_top_k(kept.collect())
    for wrong in (frame, spark.createDataFrame([(0, [1e17])], "vec_id long, embedding array<double>")):
        with pytest.raises(Exception, match="64"):
            topk.search(wrong).collect()


def test_cutoffs_leave_out_blocks_and_entries():
    import pyarrow as pa

    draw = np.random.default_rng(4)
    center = draw.normal(size=(2, 32))
    near = [(center[i % 2] * (10 if i % 2 else 0.1) + draw.normal(size=32) * 0.05) * 256 for i in range(600)]
    block = topk.Block(np.arange(600), np.arange(600), pa.array([np.floor(v).astype(int).tolist() for v in near], pa.list_(pa.int64())), 4)
    queries = topk.Block(np.arange(600)[1::60], np.arange(600)[1::60], pa.array(block.v[1::60].tolist(), pa.list_(pa.int64())), 4)
    scores = queries.v @ block.v.T
    scores[queries.rows[:, None] == block.rows] = -(1 << 62)
    cutoff = np.sort(scores, 1)[:, -5]
    best = topk.Best(len(queries.ids), 5)
    skipped = topk.collect(queries, block, 4, cutoff, best)
    assert skipped[1:].sum() > scores.size / 3
    expected = [sorted(zip(-line, block.ids), key=tuple)[:5] for line in scores]
    assert [(-s, i) for s, i in zip(best.score, best.id)] == [pair for line in expected for pair in line]
    small = topk.Block(np.arange(300), np.arange(300), pa.array(block.v[::2].tolist(), pa.list_(pa.int64())), 4)
    assert topk.collect(queries, small, 4, cutoff, topk.Best(len(queries.ids), 5))[0] == 300 * len(queries.ids)


def test_top_k_leaves_the_session_alone(spark, tables):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    topk.search(common.table(spark, tables, "embeddings")).count()
    assert spark.conf.get(name) == before


def test_pipeline(spark, tables):
    docs = common.table(spark, tables, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, tables), "test-stage")
        assert docs.columns == common.DOCUMENT_COLUMNS
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    texts = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in encoded) == texts
