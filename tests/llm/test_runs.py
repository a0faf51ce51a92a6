import hashlib
import random

import pytest

from leafmill.llm import runs
from leafmill.llm.queries import QUERIES


def plain_runs(w, least):
    """Every period tried at every place."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def words_of(rnd, n):
    w = [rnd.choice("abcde"[: rnd.choice([1, 2, 3, 5])]) for _ in range(n)]
    if rnd.random() < 0.5 and n > 6:
        a, p = rnd.randrange(n // 2), rnd.randrange(1, n // 2)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_equal_all_periods_tried():
    rnd = random.Random(3)
    for _ in range(1500):
        w = words_of(rnd, rnd.randrange(70))
        assert sorted((s, e - s + 1, q) for (s, q), e in runs.all_runs(w).items()) == plain_runs(w, 2)
        assert sorted(runs.find_runs(w)) == plain_runs(w, runs.LEAST)


def test_filter_keeps_runs_between_other_words():
    rnd = random.Random(4)
    for _ in range(200):
        w = []
        for _ in range(rnd.randrange(1, 6)):
            w += [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40))] + words_of(rnd, rnd.randrange(60)) * rnd.choice([1, 1, 2, 3])
        assert sorted(runs.find_runs(w)) == plain_runs(w, runs.LEAST)


def test_long_periodic_texts_take_linear_time():
    assert runs.find_runs(["x"] * 300_000) == [(0, 300_000, 1)]
    assert runs.find_runs([str(i % 7000) for i in range(100_000)]) == [(0, 100_000, 7000)]


def test_operator_on_odd_rows(spark):
    text = "Start " + "a b\t" * 8 + "\n\nend ü " + "z " * 11
    rows = [(1, text, "r"), (1, text, "r"), (2, None, None), (3, "", "x"), (4, " \n\t", "x"), (None, "q " * 12, "x"), (5, "a b " * 12, "x"), (6, " ".join(map(str, range(200_000))) + " k" * 50, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    out = runs.periodic_runs(docs, collapsed="Collapsed")
    assert out.columns == ["doc_id", "text", "runs", "Collapsed"]
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert [tuple(r) for r in by[1]["runs"]] == [(1, 16, 2)] and by[1]["Collapsed"] == "Start a b end ü" + " z" * 11
    assert [by[k]["runs"] for k in (2, 3, 4)] == [[]] * 3 and [by[k]["Collapsed"] for k in (2, 3, 4)] == [""] * 3
    assert [tuple(r) for r in by[None]["runs"]] == [(0, 12, 1)] and by[None]["Collapsed"] == "q"
    assert [tuple(r) for r in by[5]["runs"]] == [(0, 12, 1)]  # only ASCII white space parts words
    assert [tuple(r) for r in by[6]["runs"]] == [(200_000, 50, 1)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, least=4)


def test_query_digests(spark, tmp_path):
    import zlib

    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    texts = ["one two three four five six seven eight nine ten eleven twelve thirteen"] * len(ids)
    spark.createDataFrame([*zip(ids, texts), (None, None), (1000, "a b " * 6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    for k in ids:
        w = texts[0].split()
        n, g = len(w), zlib.crc32(str(k).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = plain_runs(w, 12)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in want)
        assert got[k]["n_runs"] == len(want) and got[k]["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    best = got[1000]
    assert [best[c] for c in ("n_runs", "start", "length", "period", "exponent_milli")] == [1, 0, 12, 2, 6000]
    assert best["collapsed_sha256"] == hashlib.sha256(b"a b").hexdigest()
    none = got[None]
    assert none["n_runs"] == 0 and none["start"] is None and none["runs_sha256"] == none["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
