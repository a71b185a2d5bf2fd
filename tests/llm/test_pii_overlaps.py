"""Overlaps of looser candidates count among those that the classifier accepts."""

from tendergrid.llm import pii

SCHEMA = "doc_id long, text string"
VALIDITY = [0.0] * 5 + [5.0] + [0.0] * 5
ALL = [5.0] + [0.0] * 10


def spans(spark, text, weights):
    model = spark.createDataFrame([(weights,)], "weights array<double>")
    found = pii.spans_of(spark.createDataFrame([(1, text)], SCHEMA), ["doc_id"])
    return [(s.kind, text[s.start : s.end]) for s in pii.decided(found, model).head()["_spans"]]


def test_rejected_candidates_hide_none(spark):
    text = "+1 (826) 555-4081 190.137.223.204"
    expected = [("ip", "190.137.223.204"), ("phone", "(826) 555-4081")]
    assert spans(spark, text, VALIDITY) == expected
    # Accepted or not, the long match overlaps a base span.
    assert spans(spark, text, ALL) == expected


def test_accepted_candidates_do_not_overlap(spark):
    text = "+1 (826) 555-4081 12 34 56 78 90 12"
    assert spans(spark, text, VALIDITY) == [("phone", "(826) 555-4081")]
    assert spans(spark, text, ALL) == [("phone", text)]
