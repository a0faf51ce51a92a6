"""Toxicity (operator 5): a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The n-grams are runs of 3 to 6 bytes of the lower-cased text, between spaces. Feature j of a text has the value
r_j * count_j / norm, r_j being the log ratio of its smoothed shares in toxic and other texts, and norm the length of the
vector of the counts of 6-grams hashed to few bins. Null and empty texts have the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from leafmill.llm import linear
from leafmill.llm.common import LOWER, UPPER, cut, pieces

BITS = 18
EPOCHS = 4
ORDERS = (3, 4, 5, 6)
SMOOTH = 1.0
SCALE = 7.0
NORM_BINS = 4096
_TABLE = bytes.maketrans((UPPER + "\t\n\v\f\r").encode(), (LOWER + " " * 5).encode())


def grams(text: str | None, bits: int = BITS) -> Iterator[tuple[int, np.ndarray]]:
    """The orders and indices of a whole text's n-grams, with repeats, in several arrays."""
    data = b" " + (text or "").encode("utf-8", "surrogatepass").translate(_TABLE) + b" "
    last = b""
    for piece in pieces(data):
        b = np.frombuffer(last + piece, np.uint8).astype(np.uint64)
        h = np.zeros(len(b), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :] + np.uint64(n == 1)
            if n in ORDERS:
                # those wholly inside what the piece before brought have been seen
                new = h[max(0, len(last) - n + 1) :]
                yield n, (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
        last = (last + piece)[1 - max(ORDERS) :]



def counts(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Distinct indices of a text, their counts, and what its values are divided by."""
    held, bins = {}, np.zeros(NORM_BINS)
    for n, at in grams(text, bits):
        if n == max(ORDERS):
            bins += np.bincount(at & (NORM_BINS - 1), minlength=NORM_BINS)
        at, count = np.unique(at, return_counts=True)
        if held:
            at, where = np.unique(np.concatenate([held["at"], at]), return_inverse=True)
            count = np.bincount(where, np.concatenate([held["count"], count]))
        held = {"at": at, "count": count}
    if not held:
        return np.empty(0, np.int64), np.empty(0), 1.0
    return held["at"], held["count"], max(1.0, float(np.sqrt(bins @ bins))) / SCALE


def fit(docs: DataFrame, labels: DataFrame, learn: Column, bits: int = BITS, epochs: int = EPOCHS, rows: int = linear.SAMPLE_ROWS) -> np.ndarray:
    """Bias and weights by index, learnt from the labelled documents for which ``learn`` holds, at most about ``rows``.

    First every shard counts the n-grams of toxic and other rows; the counts' sums give the log ratios, by which the
    features of the second pass are scaled. Without any labelled document all scores are 0.5.
    """
    size = 1 << bits

    def count(part: list[tuple[str, int]]) -> bytes:
        sums = np.zeros((2, size), np.int64)
        for text, y in part:
            at, n, _ = counts(text, bits)
            sums[y][at] += n.astype(np.int64)
        return sums.tobytes()

    sample = cut(linear.labelled_sample(docs, labels, "toxic", learn, rows))
    sums = [np.frombuffer(b, np.int64).reshape(2, size) for b in linear.by_shard(sample, count)]
    if not sums:
        return np.zeros(size + 1, np.float32)
    shares = np.sum(sums, axis=0) + SMOOTH
    shares = shares / shares.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    held = sample.sparkSession.sparkContext.broadcast(ratio)

    def work(part: list[tuple[str, int]]) -> bytes:
        rows = []
        for text, y in part:
            at, n, norm = counts(text, bits)
            rows.append(linear.compact_row(np.append(at, size), np.append(held.value[at] * n / norm, 1.0), y))
        return linear.train(rows, size + 1, epochs).tobytes()

    weights = np.mean([np.frombuffer(b, np.float32) for b in linear.by_shard(sample, work)], axis=0)
    return np.append(weights[-1:], weights[:-1] * ratio).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row; more is more toxic. Only the text counts, and all of it."""
    held, bits = docs.sparkSession.sparkContext.broadcast(weights), int(len(weights) - 1).bit_length() - 1

    def one(text: str | None) -> float:
        total, bins = 0.0, np.zeros(NORM_BINS)
        for n, at in grams(text, bits):
            total += float(held.value[1:][at].sum(dtype=np.float64))
            if n == max(ORDERS):
                bins += np.bincount(at & (NORM_BINS - 1), minlength=NORM_BINS)
        return linear.sigmoid(float(held.value[0]) + total / max(1.0, float(np.sqrt(bins @ bins))) * SCALE)

    return linear.add_scores(docs, one, column)
