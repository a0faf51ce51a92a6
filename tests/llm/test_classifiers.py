import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality, queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    labels = np.array(labels)
    return (order[labels == 1].mean() - (labels.sum() - 1) / 2) / (labels == 0).sum()


@pytest.mark.parametrize("query, label, mod, out, least, precision", [(queries.op10_quality, "quality", 4, 2, 0.99, 0.97), (queries.op5_toxicity, "toxic", 3, 1, 0.95, 0.9)])
def test_held_out_documents(spark, query, label, mod, out, least, precision):
    rows = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % mod == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(rows[k].score, y) for k, y in labels.items() if k in rows and rows[k].held_out]
    assert auc(*zip(*held)) > least
    named = [y for s, y in held if s >= 0.7]
    assert sum(named) / len(named) > precision


@pytest.mark.parametrize("op", [quality, toxicity])
def test_odd_rows(spark, op):
    docs = spark.createDataFrame([(1, "good words here", 5), (None, None, 6), (2, "", 7), (2, "", 7), (3, "x " * 200_000, 8)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    weights = op.fit(docs, labels, F.lit(True))
    out = op.score(docs, weights)
    assert sorted(out.columns) == ["doc_id", "score", "text"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    nothing = op.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in op.score(docs, nothing).collect()} == {0.5}
    assert op.score(docs.limit(0), weights).collect() == []


def test_accepted_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, _score string")
    out = quality.accepted(docs, np.zeros(1 << 18, np.float32))
    assert out.columns == docs.columns and out.count() == 1


def test_a_score_does_not_depend_on_pieces(monkeypatch):
    text = "Some Words!! and 12 more $$$ " * 3000
    whole = np.sort(quality.features(text)), toxicity.counts(text)
    monkeypatch.setattr("leafmill.llm.common.pieces.__defaults__", (1000,))
    parts = np.sort(quality.features(text)), toxicity.counts(text)
    assert (whole[0] == parts[0]).all()
    assert (whole[1][0] == parts[1][0]).all() and (whole[1][1] == parts[1][1]).all() and np.isclose(whole[1][2], parts[1][2])
