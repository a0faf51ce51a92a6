"""Quality classifier (operator 10): hashed word n-grams, logistic regression by FTRL-proximal, sparse dot products.

Features of a text, all hashed to ``2 ** BITS`` indices: lower-cased words and pairs of words, the shapes of words
(letters, capitals, digits and marks, runs made one) and pairs of shapes, and whether a word repeats the one before.
A row is scaled to unit length, so that long and short texts compare. Null and empty texts have the bias alone.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import linear
from leafmill.llm.common import CACHED_WORDS, CACHES, fresh, mix, pieces

BITS = 18
EPOCHS = 4
_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]
_MARKS = re.compile(rb"([^aA0])\1+")


class _Words(dict):
    """By word: its hash in the upper 48 bits, that of its shape in the lower 16."""

    def __missing__(self, word: bytes) -> int:
        shape = word
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
        shape = _MARKS.sub(rb"\1", shape)[:24]
        value = xxhash.xxh3_64_intdigest(word.lower()) & ~0xFFFF | xxhash.xxh3_64_intdigest(shape) & 0xFFFF
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


_WORDS = _Words()
CACHES.append(_WORDS)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The feature indices of a text, from 1, with repeats."""
    out = []
    last = np.empty(0, np.uint64)
    for piece in pieces((text or "").encode("utf-8", "surrogatepass")):
        words = piece.split()
        both = np.concatenate([last, np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))])
        word, shape = both >> np.uint64(16), both & np.uint64(0xFFFF)
        n = len(last)
        with np.errstate(over="ignore"):
            out += [mix(word[n:], 1), mix(shape[n:], 2)]
            out += [mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:], 3), mix(shape[:-1] << np.uint64(16) | shape[1:], 4)]
            out += [mix((word[:-1] == word[1:]).astype(np.uint64), 5)]
        last = both[-1:]
    return (np.concatenate(out) % np.uint64((1 << bits) - 1)).astype(np.int64) + 1


def row(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and values of unit length, and the bias."""
    at, n = np.unique(features(text, bits), return_counts=True)
    x = np.sqrt(n)
    x = x / max(1e-9, np.sqrt(n.sum())) * 3
    return np.concatenate([[0], at]), np.concatenate([[1.0], x])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, bits: int = BITS, epochs: int = EPOCHS, rows: int = linear.SAMPLE_ROWS) -> np.ndarray:
    """Weights learnt from the labelled documents for which ``learn`` holds, at most about ``rows`` of them.

    Without any labelled document all weights are 0 and every score is 0.5.
    """

    def work(part: list[tuple[str, int]]) -> bytes:
        return linear.train([linear.compact_row(*row(t, bits), y) for t, y in part], 1 << bits, epochs).tobytes()

    blobs = linear.by_shard(linear.labelled_sample(docs, labels, "quality", learn, rows), work)
    return np.mean([np.frombuffer(b, np.float32) for b in blobs], axis=0) if blobs else np.zeros(1 << bits, np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row; more is better. Only the text counts, and all of it."""
    held, bits = docs.sparkSession.sparkContext.broadcast(weights), int(len(weights)).bit_length() - 1

    def one(text: str | None) -> float:
        at, x = row(text, bits)
        return linear.sigmoid(float(held.value[at] @ x))

    return linear.add_scores(docs, one, column)


def accepted(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    column = fresh(docs, "_score")
    return score(docs, weights, column).filter(F.col(column) >= least).drop(column)
