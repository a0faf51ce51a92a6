"""What the two text classifiers share: a bounded labelled sample, and online training by shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import in_python

#: Most labelled rows that a classifier learns from (on average: rows are chosen by a hash of their id).
SAMPLE_ROWS = 20_000
#: The sample is trained in so many parts; their weights are averaged.
SHARDS = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, y, shard`` of at most about ``rows`` labelled documents for which ``learn`` (on doc_id) holds.

    Null ids and null labels take no part; an id with several labels has their rounded mean. Which rows are chosen
    depends only on their ids. The chosen labels are bounded by ``rows``, so they are broadcast and no text is shuffled
    but that of the sample.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20))
    known = known.filter(pick < int(share * (1 << 20)))
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("shard")), F.lit(SHARDS)).cast("int")
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", shard.alias("shard"))


def by_shard(sample: DataFrame, work: Callable[[list[tuple[str, int]]], bytes]) -> list[bytes]:
    """``work`` on the rows of each shard, in an order that does not depend on the run; one blob from each shard.

    Shards are dealt by their range, so that each has a task of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, int]]] = {}
        for batch in batches:
            for text, y, shard in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "shard"))):
                held.setdefault(shard, []).append((text, y))
        for shard in sorted(held):
            rows = sorted(held.pop(shard), key=lambda r: (hash_text(r[0]), r[1]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([work(rows)], pa.binary())], names=["shard", "blob"])

    out = in_python(sample.repartitionByRange(SHARDS, "shard"), run, "shard int, blob binary").toArrow()
    return [b for _, b in sorted(zip(out["shard"].to_pylist(), out["blob"].to_pylist()))]


def hash_text(text: str | None) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))


class Ftrl:
    """Follow the regularised leader (proximal) for logistic regression with sparse rows; index 0 is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One step for a row whose distinct indices ``at`` have the values ``x``."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def compact_row(at: np.ndarray, x: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A row for ``train`` in half of the memory."""
    return at.astype(np.int32), x.astype(np.float32), y


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int, **settings: float) -> np.ndarray:
    """Weights after ``epochs`` passes over rows of (indices, values, label); the order is shuffled by a fixed seed."""
    model, order = Ftrl(size, **settings), np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.update(*rows[k])
    return model.weights().astype(np.float32)


def add_scores(docs: DataFrame, score: Callable[[str | None], float], column: str) -> DataFrame:
    """``docs`` with ``column``, a double, computed from its text in Arrow batches; a column of that name, in whatever case, is replaced."""
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*kept, column])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(column, T.DoubleType())])
    return in_python(docs.select(*[f"`{c}`" for c in kept]), run, schema)


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))
