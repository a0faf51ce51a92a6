from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import wordpiece as wp

TOKENS = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"abcde", b"bcd", b"cdx", b" a", b" ab", b"ba", b"bab", b"aaaa"]
SMALL = wp.Automaton(TOKENS)


def greedy(word, tokens):
    n = 0
    while word:
        size = max(k for k in range(1, len(word) + 1) if word[:k] in tokens)
        word, n = word[size:], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30) | st.lists(st.sampled_from(list(b"abcdex ")), max_size=40).map(bytes))
def test_counts_equal_a_greedy_split(word):
    assert SMALL.count(word) == greedy(word, set(TOKENS))


def test_public_vocabulary_on_whole_texts(spark):
    tokens = set(wp.load_tokens())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    got = {r.doc_id: r for r in wp.token_counts(docs).collect()}
    for r in docs.collect():
        words = r.text.encode().split()
        assert got[r.doc_id].n_words == len(words)
        assert got[r.doc_id].n_tokens == sum(greedy(b" " + w, tokens) for w in words)


def test_nulls_empty_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "the cat", 1), (1, None, 2), (1, "", 3), (2, " \n ", 4)], "doc_id long, text string, n_tokens int")
    out = wp.token_counts(df).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in out) == [(0, 2), (1, 0), (1, 0), (2, 0)]
    assert wp.token_counts(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    tokens = set(wp.load_tokens())
    rows = [(1, "word wörd " * 300_000), (2, "x" * 300_000), (3, "\n" * 2_000_000 + "end")]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wp.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (600_000, 300_000 * (greedy(b" word", tokens) + greedy(" wörd".encode(), tokens)))
    assert got[2][0] == 1 and got[3] == (1, greedy(b" end", tokens))
