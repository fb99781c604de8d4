import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import quality_classifier as Q


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    ones = int(y.sum())
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    scored = Q.with_scores(docs.select("doc_id", "text"), model).join(labels, "doc_id")
    rows = scored.filter(Q.fold(F.col("doc_id")) == 1).select("score", "quality").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert len(rows) > 80 and auc(y, s) > 0.95 and ((s >= 0.5) == y).mean() > 0.93


def test_hard_rows(spark, hard_docs, no_docs):
    model = Q.train(["good words here", "BAD!! BAD!!"] * 20, [1, 0] * 20)
    rows = Q.with_scores(hard_docs, model).collect()
    assert len(rows) == hard_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.text or "").strip()} and rows[0].spans == "x"
    assert Q.with_scores(no_docs, model).count() == 0


def test_long_text_scores_as_its_parts():
    model = Q.train(["good words here", "BAD!! BAD!!"] * 20, [1, 0] * 20)
    a, b = model.score(["good words here", "good words here\n" * 5000])
    assert abs(a - b) < 0.2 and b > 0.5


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.with_scores(docs, Q.fit(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (4, None)], "doc_id long, quality int")
    assert min(r.score for r in Q.with_scores(docs, Q.fit(docs, odd)).collect()) > 0.9


def test_long_texts_are_no_examples(spark, monkeypatch):
    """One long text early in the order neither ends the sample nor empties it; nothing but long ones is an error."""
    rows = [(i, ("good words here " if i % 2 else "BAD!! BAD!! ") * (500 if i < 3 else 1)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    monkeypatch.setattr(Q, "LONGEST_TEXT", 1000)
    monkeypatch.setattr(Q, "TRAIN_BYTES", 1200)
    model = Q.fit(docs, labels)
    good, bad = model.score(["good words here", "BAD!! BAD!!"])
    assert good > 0.5 > bad
    monkeypatch.setattr(Q, "LONGEST_TEXT", 5)
    with pytest.raises(ValueError):
        Q.fit(docs, labels)
