"""Near duplicates against brute force on the operator's own measure; crowded buckets and joined families."""

import collections

import numpy as np

from tendergrid.llm import common, near_dup


def labels_of(rows):
    words = rows.selectExpr("doc_id", f"{near_dup.words_of('coalesce(text, "")')} AS words").collect()
    return {r.doc_id: near_dup.labelled(np.array(r.words, np.int64)) for r in words if r.words}


def components(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def links_in_buckets(labels):
    buckets = collections.defaultdict(list)
    for i, own in labels.items():
        for number in near_dup.sketch(own):
            buckets[number].append(i)
    pairs = {(a, b) for held in buckets.values() for a in held for b in held if a < b}
    return [(a, b) for a, b in pairs if near_dup.similarity(labels[a], labels[b]) > 0]


def classes_of(rows):
    return {r.doc_id: r.class_id for r in near_dup.classify(rows).collect()}


def crowded():
    """Pairs of 8 and 9 words (0.8 alike), each amid texts that hold the same 8 words but are unlike."""
    number, out = 0, []
    for family in range(12):
        passage = [f"p{family}x{i}" for i in range(8)]
        for text in [passage, [*passage, "end"]] + [[f"u{family}x{i}y{k}" for k in range(2)] + passage for i in range(150)]:
            out.append((number, " ".join(text)))
            number += 1
    return out


def families():
    """Two groups of variants of a text, joined by one pair of texts; variants change one word each."""
    changed, number, out = (30, 70, 110, 150), 0, []
    places = [at for at in range(5, 195) if all(abs(at - c) >= 5 for c in changed)][:120]
    for family in range(4):
        first = [f"f{family}x{i}" for i in range(200)]
        other = [f"g{family}x{i}" if i in changed else w for i, w in enumerate(first)]
        for base in (first, other):
            out.append((number, " ".join(base)))
            for i, at in enumerate(places, 1):
                out.append((number + i, " ".join([*base[:at], f"v{number}x{i}", *base[at + 1 :]])))
            number += 1 + len(places)
    return out


def test_crowded_buckets_lose_no_pair(spark):
    rows = spark.createDataFrame(crowded(), "doc_id long, text string")
    labels = labels_of(rows)
    assert classes_of(rows) == components(labels, links_in_buckets(labels))


def test_families_joined_by_one_pair(spark):
    rows = spark.createDataFrame(families(), "doc_id long, text string")
    labels = labels_of(rows)
    assert classes_of(rows) == components(labels, links_in_buckets(labels))


def test_blocks_of_a_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    for made in (crowded(), families()):
        rows = spark.createDataFrame(made, "doc_id long, text string")
        labels = labels_of(rows)
        assert classes_of(rows) == components(labels, links_in_buckets(labels))


def test_buckets_parted_by_rare_labels_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_dup, "MOST_BLOCKS", 2)
    sent = []
    whole = near_dup._parted
    monkeypatch.setattr(near_dup, "_parted", lambda state, texts: sent.append((state.count(), (out := whole(state, texts)).count())) or out)
    for made in (crowded(), families()):
        rows = spark.createDataFrame(made, "doc_id long, text string")
        labels = labels_of(rows)
        assert classes_of(rows) == components(labels, links_in_buckets(labels))
    # Few texts of the crowded buckets share one of their rare labels.
    assert sent[0][1] < sent[0][0]


def test_copies_are_joined_in_pieces(spark, monkeypatch):
    """Most rows are one text, some of them without doc_id; pieces of ten rows."""
    monkeypatch.setattr(near_dup, "COPIES", 10)
    base = " ".join(f"w{i}" for i in range(60))
    made = [(i if i % 3 else None, base) for i in range(300)] + [(1000 + i, f"{base} end{i}") for i in range(30)] + [(2000, None), (2001, "")]
    rows = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    found = collections.Counter((r.doc_id, r.class_id) for r in near_dup.classify(rows).collect())
    assert found == collections.Counter((i, 2000 if not text else 1) for i, text in made)


def test_only_lasting_tables_stay(spark):
    import glob

    from tendergrid import session

    rows = spark.createDataFrame(families()[:200], "doc_id long, text string")
    pattern = session.work_folder(spark, "x").rsplit("/", 1)[0] + "/llm-*"
    before = set(glob.glob(pattern))
    near_dup.classify(rows).count()
    stay = {path.rsplit("/", 1)[1][4:].rsplit("-", 1)[0] for path in set(glob.glob(pattern)) - before}
    assert stay == {"near-keys", "near-classes"}


def test_documents_against_brute_force(spark, tables):
    """All pairs of texts by the operator's own measure; what a sketch misses shares no bucket."""
    rows = common.table(spark, tables, "documents").select("doc_id", "text")
    last = rows.agg({"doc_id": "max"}).head()[0]
    base = [f"w{(i * 7919) % 4001}" for i in range(300)]
    near = [(last + 1 + n, " ".join(w if (i + 31 * n) % 97 else f"changed{n}" for i, w in enumerate(base))) for n in range(6)]
    rows = rows.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    labels = labels_of(rows)
    found = classes_of(rows)
    linked = [(a, b) for a in labels for b in labels if a < b and near_dup.similarity(labels[a], labels[b]) > 0]
    assert len(linked) >= 15
    sketches = {i: set(near_dup.sketch(own)) for i, own in labels.items()}
    met = [(a, b) for a, b in linked if sketches[a] & sketches[b]]
    assert len(met) >= 0.99 * len(linked)
    assert {i: found[i] for i in labels} == components(labels, met)
