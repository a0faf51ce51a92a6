import random

import numpy as np
import pytest

import corpus_pipeline as cp
from leafmill.llm import packing, queries

from ..compare import same_rows

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count()
        assert docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
        if name != "mixing sources to target weights":
            assert docs.count() <= before.count()
    packed = cp.STAGES[-1][1](spark, docs, FOLDER).collect()
    ids = [d for r in packed for d, part in zip(r.doc_ids, r.parts) if part == 0]
    assert sorted(ids) == sorted(r.doc_id for r in docs.collect())
    assert sorted(ids) == sorted(d for r in cp.run(spark, FOLDER).collect() for d, part in zip(r.doc_ids, r.parts) if part == 0)


def test_stages_on_a_fixture(spark, tmp_path):
    """Planted cases: near copies, a leaked item, bad text; all else stays."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    good = [(k, text(80), "en", f"s{k % 3}", 1) for k in range(120)]
    bad = [(200 + k, " ".join(w.upper() + "!!" for w in text(80).split()), "en", "s0", 1) for k in range(60)]
    item = text(30)
    leaked, copy = (400, f"{text(60)} {item} {text(60)}", "en", "s1", 1), (401, good[7][1] + " end", "en", "s1", 1)
    folder = str(tmp_path)
    spark.createDataFrame(good + bad + [leaked, copy], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in good] + [(d[0], 0, 0) for d in bad], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = list(range(120))
    docs = cp.quality_stage(spark, docs, folder)
    assert ids(docs) == kept + [400, 401]
    docs = cp.near_duplicate_stage(spark, docs, folder)
    assert ids(docs) == kept + [400]
    docs = cp.decontamination_stage(spark, docs, folder)
    assert ids(docs) == kept
    mixed = cp.mixing_stage(spark, docs, folder)
    assert set(ids(mixed)) <= set(kept) and abs(mixed.count() - 120) <= 3
    rows = cp.packing_stage(spark, mixed, folder).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(np.frombuffer(packing.Tokens().encode(r.text), "<u2")) + 1 for r in mixed.collect())


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_stages_on_an_empty_table(spark, k):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert cp.STAGES[k][1](spark, docs, FOLDER).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.SQL[name], FOLDER)


def test_the_whole_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
