import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import packing as pk

TOKENS = pk.Tokens()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 '\n\t.é中st　", max_size=40))
def test_cached_pieces_give_the_tokenizers_ids(text):
    assert np.frombuffer(TOKENS.encode(text), "<u2").tolist() == TOKENS.encoder.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = pk.pack(lengths, 20)
    assert sorted(k for row in rows for k in row) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in row) <= 20 for row in rows)
    # the plain form of the same rule
    plain = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = [20 - sum(lengths[j] for j in row) for row in plain]
        fits = [r for r in room if r >= lengths[k]]
        if fits:
            plain[room.index(min(fits))].append(k)
        else:
            plain.append([k])
    assert sorted(sum(lengths[k] for k in r) for r in rows) == sorted(sum(lengths[k] for k in r) for r in plain)


def unpack(rows):
    docs = {}
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == r.n_tokens == r.cu_seqlens[-1]
        for a, b, doc, part, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.parts, r.starts):
            assert positions[a:b].tolist() == list(range(b - a))
            docs.setdefault(doc, []).append((part, start, ids[a:b]))
    return {d: np.concatenate([x for _, _, x in sorted(p, key=lambda x: x[0])]) for d, p in docs.items()}


def test_whole_documents_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pk.pack_documents(docs).collect()
    assert len({r.pack_id for r in rows}) == len(rows) and max(r.n_tokens for r in rows) <= pk.WIDTH
    back = unpack(rows)
    for r in docs.collect():
        assert back[r.doc_id][-1] == pk.END_OF_TEXT
        assert TOKENS.decode(back[r.doc_id][:-1]) == r.text


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (None, "a b", 0)], "doc_id long, text string, parts int")
    rows = pk.pack_documents(df.coalesce(1)).collect()
    assert sorted(map(str, (d for r in rows for d in r.doc_ids))) == ["1", "2", "None", "None"]
    assert pk.pack_documents(df.limit(0)).collect() == []


def test_written_matrices(spark, tmp_path):
    packed = pk.pack_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)).cache()
    index = pk.write_matrices(packed, f"file://{tmp_path}")
    want = {r.pack_id: r for r in packed.collect()}
    assert {r.pack_id: r for r in pk.read_matrices(index).collect()} == want
    rows = index.collect()
    assert len(rows) == len(want)
    for path in {r.path for r in rows}:
        own = sorted((r for r in rows if r.path == path), key=lambda r: r.row)
        ids = np.fromfile(path.removeprefix("file://"), "<u2").reshape(len(own), pk.WIDTH)
        resets = np.fromfile(path.removeprefix("file://") + ".resets", "<i8")
        positions = np.arange(ids.size) - resets[np.searchsorted(resets, np.arange(ids.size), "right") - 1]
        ends = np.fromfile(path.removeprefix("file://") + ".cu", "<i8")
        at = 0
        for r, row, position in zip(own, ids, positions.reshape(ids.shape)):
            w = want[r.pack_id]
            assert bytes(w.input_ids) == row[: r.n_tokens].tobytes() and (row[r.n_tokens :] == pk.END_OF_TEXT).all()
            assert np.frombuffer(w.position_ids, "<u2").tolist() == position[: r.n_tokens].tolist()
            assert position[r.n_tokens :].tolist() == list(range(pk.WIDTH - r.n_tokens))
            assert ends[at : at + r.segments + 1].tolist() == w.cu_seqlens
            at += r.segments + 1
    assert pk.read_matrices(pk.write_matrices(packed.limit(0))).collect() == []


def test_long_runs_of_white_space_are_pieces_as_for_the_tokenizer(monkeypatch):
    rng = random.Random(4)
    for space in (" ", "\n", "\u3000", " \t"):
        for _ in range(20):
            text = "".join(rng.choice(["a", "1b", ".", space * rng.randint(1, 1500), " c"]) for _ in range(8))
            assert np.frombuffer(TOKENS.encode(text), "<u2").tolist() == TOKENS.encoder.encode_ordinary(text)


def test_very_long_texts(spark):
    rows = [(1, "x" + " " * 5_000_000 + "y"), (2, "ab" * 2_500_000), (3, "\n" * 2_000_000), (4, "one two " * 200_000)]
    back = unpack(pk.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for doc, text in rows:
        assert TOKENS.decode(back[doc][:-1]) == text and back[doc][-1] == pk.END_OF_TEXT
