"""Token counts (operator 3): greedy longest-match word pieces, counted by a linear automaton.

The automaton is a trie of the vocabulary. A node's failure link says where reading goes on when no child matches: the
longest token that begins the node's text is popped, then the longest that begins what is left, until the rest is again
a node. The number of tokens popped on the way is computed once for each node, so that the length of a word's greedy
split is found in one pass over its bytes, without making the pieces.

Vocabulary: the ranks file of a byte-level tokenizer (base64 token and rank by line). A word is what stands between
spaces; its bytes follow one space, so tokens that begin with a space begin words and all others continue them. Every
single byte is a token, so each word can be split.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import CACHED_WORDS, CACHES, in_python, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_tokens(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Nodes are numbers, 0 the root. ``depth`` equals the number of bytes read since the last popped token."""

    def __init__(self, tokens: list[bytes]):
        self.children: list[dict[int, int]] = [{}]
        ends = [False]
        for token in tokens:
            node = 0
            for byte in token:
                at = self.children[node].get(byte)
                if at is None:
                    at = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    ends.append(False)
                node = at
            ends[node] = node > 0
        single = self.children[0]
        missing = [b for b in range(256) if b not in single or not ends[single[b]]]
        if missing:
            raise ValueError(f"not tokens: the bytes {missing[:5]}")
        # breadth first: a parent's link and count are known before its children's
        self.link, self.popped = array("l", [-1]) * len(ends), array("l", [0]) * len(ends)
        level = [0]
        while level:
            after = []
            for parent in level:
                for byte, node in self.children[parent].items():
                    after.append(node)
                    if ends[node]:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, n = self.link[parent], self.popped[parent]
                    while byte not in self.children[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    self.link[node], self.popped[node] = self.children[at][byte], n
            level = after

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match tokens of ``word``, in time proportional to its length."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for byte in word:
            at = children[node].get(byte)
            while at is None:
                total += popped[node]
                node = link[node]
                at = children[node].get(byte)
            node = at
        while node:
            total += popped[node]
            node = link[node]
        return total


class WordCounts(dict):
    """Tokens by word, for at most ``CACHED_WORDS`` words."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        CACHES.append(self)

    def __missing__(self, word: bytes) -> int:
        value = self.automaton.count(b" " + word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


_COUNTS: dict[str, WordCounts] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_bytes`` of each row's whole text; null and empty texts have 0.

    Rows are kept as they are, repeated ones too; other columns are dropped. Workers read the vocabulary file, which
    must be at ``vocabulary`` on each of them, once. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTS:
            _COUNTS[vocabulary] = WordCounts(Automaton(load_tokens(vocabulary)))
        by_word = _COUNTS[vocabulary].__getitem__
        for batch in batches:
            words, tokens, size = [], [], []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                n = total = 0
                for piece in pieces(data):
                    split = piece.split()
                    n += len(split)
                    total += sum(map(by_word, split))
                words.append(n)
                tokens.append(total)
                size.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, size))], names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    return in_python(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_bytes long")
