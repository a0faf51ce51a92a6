import collections
import random

import numpy as np
import pytest

from leafmill.llm import suffixdedup as sd

SCHEMA = "doc_id long, text string"


def brute(texts, span=sd.SPAN):
    count = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    shared, edge = prose(rng, 80), prose(rng, 40)[:199]
    near = prose(rng, 200)
    texts = [f"{prose(rng, 30)} {shared} {prose(rng, 30)}" for _ in range(6)]
    texts += [near, near.replace(" a", " zz", 3), near[50:] + "!", prose(rng, 20) + edge, edge + prose(rng, 20)]
    texts += ["For " * 400, "x" + "For " * 90, "é" * 150 + "ü", "é" * 150 + "ü", "", None, "short", prose(rng, 150), "\x00" * 210]
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {r.doc_id: r for r in sd.remove_repeats(rows).collect()}
    data = [(t or "").encode() for t in texts]
    for k, kept in enumerate(brute(data)):
        assert bytes(got[k].kept) == kept, k
        assert got[k].n_bytes == len(data[k])
        assert sum(s.stop - s.start for s in got[k].spans) == len(data[k]) - len(kept)
        assert all(a.stop < b.start for a, b in zip(got[k].spans, got[k].spans[1:]))


def test_hot_cores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_ANCHORS", 2)  # cores of the shared passage are hot, others are merged
    monkeypatch.setattr(sd, "PART_ANCHORS", 3)
    test_equals_brute_force(spark)
    rng = random.Random(8)
    passage = prose(rng, 25)[:150]
    texts = [f"{prose(rng, rng.randrange(12))} {passage} {rng.choice(['same end of it', ''])} {prose(rng, rng.randrange(12))}" for _ in range(30)]
    texts += texts[:3] + [texts[4][3:], texts[5][:-4]]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    got = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(rows).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts])))


def test_repeated_rows_nulls_and_other_columns(spark):
    long = prose(random.Random(5), 100)
    rows = [(1, long, "a"), (1, long, "b"), (None, long[:250], "c"), (2, "tiny", None), (2, "tiny", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", kept string").select("kept", "text", "doc_id")
    out = sd.remove_repeats(df).collect()
    assert len(out) == 5
    assert sorted((r.doc_id or 0, len(r.kept)) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 4), (2, 4)]


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_longer_than_a_piece(monkeypatch):
    rng = random.Random(1)
    text = prose(rng, 3000).encode()
    whole = sd.anchors(text)
    monkeypatch.setattr(sd, "PIECE", 1000)
    parts = sd.anchors(text)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 8])
def test_loser_tree_merges_in_order_with_common_prefixes(runs):
    rng = random.Random(runs)
    words = [[bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 30))] for _ in range(runs)]
    words = [sorted(w) for w in words]
    coded = [([0, *(sd.common(a, b, 0) for a, b in zip(w, w[1:]))], w) for w in words]
    out = list(sd.merge(coded))
    merged = [words[r][k] for r, k, _ in out]
    assert merged == sorted(w for run in words for w in run)
    assert [x for _, _, x in out][1:] == [sd.common(a, b, 0) for a, b in zip(merged, merged[1:])]


def test_a_run_decodes_to_itself():
    rows = sorted((bytes(np.random.default_rng(k).integers(97, 100, 70, np.uint8)), b"x" * k, k or None, -k, k) for k in range(50))
    shared, suffixes, before, keys = sd.decode_run(sd.encode_run(rows))
    assert [(s, b, *k) for s, b, k in zip(suffixes, before, keys)] == rows
    assert shared[1:] == [sd.common(a, b, 0) for a, b in zip(suffixes, suffixes[1:])]
