"""Approximate nearest neighbours (operator 2): inverted file, product-quantised residuals, asymmetric distances, exact reranking.

A bounded sample trains coarse centroids, and codebooks for the residuals. Every vector is coded and filed under its
nearest centroid, with its distance to what its code stands for. A query probes the lists of its nearest centroids: for
each it makes a table of the distances of its own residual to all codewords and sums table entries by code. Such a sum
less the code's error is a lower bound of the exact distance. A shortlist of the least bounds is ranked by exact distance,
and then every vector whose bound is not above the k-th of these: so the k nearest of all probed vectors are found, however many
share a code. Long lists are split into blocks, and so are the queries that probe one list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from leafmill.llm.common import cut

#: The index is fitted on about so many vectors at most, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
MOST_LISTS, LEAST_PROBES = 16_384, 32
#: Vectors that are ranked first in a block; as many more follow as their bounds ask for.
SHORTLIST = 300
#: So many probes are made that they reach this share of true neighbours, as measured on so many sample vectors.
RECALL, TRIALS = 0.98, 500
CODEBOOKS, CODEWORDS, ROUNDS = 16, 256, 12
#: Vectors, and queries, that one task compares at a time.
BLOCK, QUERY_BLOCK = 8_192, 20_000


@dataclass
class Index:
    """``centroids``: lists x d. ``edges``: where the parts of a vector begin. ``books``: a codebook for each part."""

    centroids: np.ndarray
    edges: list[int]
    books: list[np.ndarray]
    #: Nearest lists that hold ``RECALL`` of the nearest neighbours of sample vectors within the sample.
    probes: int = 1

    def stacked(self) -> tuple[np.ndarray, int]:
        """The codebooks as one array, with unused codewords and components 0, and the width of its parts."""
        width = max(b - a for a, b in zip(self.edges, self.edges[1:]))
        out = np.zeros((len(self.books), CODEWORDS, width), np.float32)
        for k, book in enumerate(self.books):
            out[k, : len(book), : book.shape[1]] = book
        return out, width

    def dump(self) -> bytes:
        import pickle

        return pickle.dumps(self)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances of the rows of two matrices."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def k_means(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """At most ``k`` centres of the distinct rows of ``x``."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS if len(distinct) > k else 0):
        near = squared(x, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, near, x)
        centres[n > 0] = (sums[n > 0] / n[n > 0][:, None]).astype(centres.dtype)
    return centres


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: rows with an id whose vector is neither null nor zero, and has only finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def fit(rows: DataFrame, total: int, seed: int = 5) -> Index:
    """An index fitted in one task on the bounded sample of ``id, v``."""
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, TRAIN_ROWS / max(1, total)) * (1 << 20))
    lists = int(max(1, min(MOST_LISTS, total**0.5)))

    def work(group: pa.Table) -> pa.Table:
        at = np.argsort(group["id"].to_numpy(), kind="stable")
        x = np.array(group["v"].to_pylist(), np.float32)[at]
        centroids = k_means(x, lists, seed)
        rest = x - centroids[squared(x, centroids).argmin(1)]
        parts = np.array_split(np.arange(x.shape[1]), min(CODEBOOKS, x.shape[1]))
        edges = [int(p[0]) for p in parts] + [x.shape[1]]
        books = [k_means(rest[:, a:b], CODEWORDS, seed) for a, b in zip(edges, edges[1:])]
        asked = np.random.default_rng(seed).permutation(len(x))[:TRIALS]
        far = squared(x[asked], x)
        far[np.arange(len(asked)), asked] = np.inf
        near = np.argsort(far, axis=1)[:, :10]
        place = np.argsort(np.argsort(squared(x[asked], centroids), axis=1), axis=1)
        own = squared(x, centroids).argmin(1)
        ranks = np.take_along_axis(place, own[near], axis=1)[np.isfinite(np.take_along_axis(far, near, axis=1))]
        probes = int(np.quantile(ranks, RECALL, method="higher")) + 1 if len(ranks) else 1
        return pa.table({"blob": pa.array([Index(centroids, edges, books, probes).dump()], pa.binary())})

    import pickle

    made = rows.filter(pick).withColumn("g", F.lit(0)).groupBy("g").applyInArrow(work, "blob binary").collect()
    return pickle.loads(made[0][0])


def encode(rows: DataFrame, index: Index, kind: str = "double") -> DataFrame:
    """``id, list, code, err, v`` of every row of ``id, v``; ``err`` is the vector's distance to what its code stands for, ``v`` an array of ``kind``."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            exact = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = exact.astype(np.float32)
            near = np.concatenate([squared(x[k : k + 4096], ix.centroids).argmin(1) for k in range(0, len(x), 4096)])
            rest = x - ix.centroids[near]
            code = np.stack([squared(rest[:, a:b], book).argmin(1) for a, b, book in zip(ix.edges, ix.edges[1:], ix.books)], axis=1).astype(np.uint8)
            off = exact.astype(np.float64) - ix.centroids[near]
            for k, (a, b, book) in enumerate(zip(ix.edges, ix.edges[1:], ix.books)):
                off[:, a:b] -= book[code[:, k]]
            err = np.sqrt((off * off).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err), batch.column(1)], names=["id", "list", "code", "err", "v"])

    rows = rows.select("id", F.col("v").cast(f"array<{kind}>").alias("v"))
    return rows.mapInArrow(run, f"id long, list int, code binary, err double, v array<{kind}>")


def groups_of(index: Index, counts: dict[int, int]) -> tuple[int, np.ndarray]:
    """Into how many groups the lists are dealt, and into how many blocks each list is split, given the lists' sizes."""
    blocks = np.ones(len(index.centroids), np.int64)
    for k, n in counts.items():
        blocks[k] = -(-n // BLOCK)
    return max(1, -(-sum(counts.values()) // BLOCK)), blocks


def probe(queries: DataFrame, index: Index, probes: int, groups: int, blocks: np.ndarray) -> DataFrame:
    """``qid, grp, block, lists, v``: for every query ``id, v`` its ``probes`` nearest lists, by the group and block that hold them."""
    held = queries.sparkSession.sparkContext.broadcast((index, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, split = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float32)
            near = np.argsort(squared(x, ix.centroids), axis=1, kind="stable")[:, :probes]
            rows = []
            for k, lists in enumerate(near.tolist()):
                by: dict[tuple[int, int], list[int]] = {}
                for one in lists:
                    for block in range(split[one]):
                        by.setdefault((one % groups, block), []).append(one)
                rows += [(k, *key, own) for key, own in by.items()]
            at = pa.array([r[0] for r in rows])
            columns = [batch.column(0).take(at), *(pa.array([r[j] for r in rows], kind) for j, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.list_(pa.int32())))), batch.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "grp", "block", "lists", "v"])

    return queries.select("id", "v").mapInArrow(run, "qid long, grp int, block int, lists array<int>, v array<double>")


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to ``v``, summed from the first component to the last."""
    return np.sqrt(((x - v) ** 2).cumsum(1)[:, -1])


class Block:
    """The vectors of a group's block, of copies of one vector only the ``k`` + 1 smallest ids: one may be the query's own."""

    def __init__(self, table: pa.Table, index: Index, k: int) -> None:
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1) + 0.0
        ids, lists = table["id"].to_numpy(), table["list"].to_numpy()
        same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, same))
        order = order[np.r_[True, (np.diff(same[order]) != 0) | (np.diff(ids[order]) != 0)]]
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        order = order[place <= k]
        order = order[np.lexsort((ids[order], lists[order]))]
        self.ids, self.lists, self.x = ids[order], lists[order], x[order]
        self.codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order].T
        self.err = table["err"].to_numpy()[order]
        self.square = (self.x * self.x).sum(1)
        self.slots = np.unique(self.ids, return_inverse=True)[1]
        self.index, self.k = index, k
        books, self.width = index.stacked()
        self.books = books.astype(np.float64)
        self.book_square = (self.books**2).sum(-1)[:, :, None]

    def bounds(self, rows: np.ndarray, at: np.ndarray, probed: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of ``v`` to ``rows``, which are in the lists ``probed[at]``."""
        ix = self.index
        off = v - ix.centroids[probed].astype(np.float64)
        rest = np.zeros((len(self.books), self.width, len(probed)))
        for k, (a, b) in enumerate(zip(ix.edges, ix.edges[1:])):
            rest[k, : b - a] = off[:, a:b].T
        tables = self.book_square - 2 * (self.books @ rest) + (rest**2).sum(1)[:, None, :]
        far = np.zeros(len(rows))
        for table, code in zip(tables, self.codes):
            far += table[code[rows], at]
        # what rounding can take from a sum of squares
        slack = 1e-12 * ((v * v).sum() + (off * off).sum(1).max() + self.book_square.max(1).sum())
        return np.sqrt(np.maximum(far - slack, 0)) * (1 - 1e-9) - self.err[rows] * (1 + 1e-9)

    def near(self, rows: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
        """Those of ``rows`` that can be of the ``k`` nearest ids of ``rows``, and a distance that these do not exceed."""
        square = (v * v).sum()
        far = self.square[rows] - 2 * (self.x[rows] @ v) + square
        slack = 1e-12 * (square + self.square[rows].max())
        own = np.full(self.slots.max() + 1, np.inf)
        np.fmin.at(own, self.slots[rows], far)
        most = np.partition(own, self.k - 1)[self.k - 1] + 2 * slack if len(own) >= self.k else np.inf
        return rows[~(far > most)], float(np.sqrt(max(most, 0)))

    def search(self, qid: int, probed: list[int], v: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest ids to ``v`` in the lists ``probed``, ties to the smaller id, and their exact distances."""
        lists = np.array(probed)
        begin, end = np.searchsorted(self.lists, lists), np.searchsorted(self.lists, lists, "right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
        at = np.repeat(np.arange(len(lists)), end - begin)
        other = self.ids[rows] != qid
        rows, at = rows[other], at[other]
        if len(rows) > first:
            low = self.bounds(rows, at, lists, v)
            _, most = self.near(rows[np.argpartition(low, first)[:first]], v)
            rows = rows[~(low > most)]
        if len(rows):
            rows, _ = self.near(rows, v)
        exact = distances(self.x[rows], v)
        order = np.lexsort((self.ids[rows], exact))
        once = np.sort(np.unique(self.ids[rows][order], return_index=True)[1])[: self.k]
        return self.ids[rows][order][once], exact[order][once]


def ranked(coded: DataFrame, queries: DataFrame, index: Index, probes: int, k: int, size: int) -> DataFrame:
    """``qid, id, score``: of each block that a query probes its ``k`` nearest ids by exact distance, ties to the smaller id.

    Lists are dealt into groups of about ``BLOCK`` vectors and longer lists split into blocks; a group's queries are split
    into sets of about ``QUERY_BLOCK``. A block ranks ``size`` vectors first, and then all that can be nearer.
    """
    spark = coded.sparkSession
    counts = {r[0]: r[1] for r in coded.groupBy("list").count().collect()}  # a row for each list: bounded
    groups, blocks = groups_of(index, counts)
    asked = cut(probe(queries, index, probes, groups, blocks))
    sets = max(1, -(-asked.count() // (groups * QUERY_BLOCK)))
    shape = F.broadcast(spark.createDataFrame(list(enumerate(blocks.tolist())), "list int, blocks long"))
    left = coded.join(shape, "list").withColumn("grp", F.col("list") % groups).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(sets)).cast("int"))
    held = spark.sparkContext.broadcast(index)

    def work(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            block = Block(vectors, held.value, k)
            for qid, probed, v in zip(queries["qid"].to_pylist(), queries["lists"].to_pylist(), queries["v"].to_pylist()):
                ids, exact = block.search(qid, probed, np.array(v, np.float64), max(size, k))
                out.append((np.full(len(ids), qid), ids, exact))
        columns = [np.concatenate([x[j] for x in out]) if out else np.empty(0) for j in range(3)]
        return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["qid", "id", "score"])

    keys = ["grp", "block", "part"]
    left, right = left.select(*keys, "list", "id", "code", "err", "v"), right.select(*keys, "qid", "lists", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "qid long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, shortlist: int = SHORTLIST) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query`` (on ``id``) holds its ``k`` nearest found among all other rows.

    ``probes``: lists searched for a query; by default as many as the sample shows to be needed. Of the vectors in these lists
    the nearest are found exactly; ``shortlist`` is how many are ranked first, and bounds nothing. ``score`` is the exact Euclidean distance in double precision; ties go to the smaller id. Rows without an id, and
    vectors that are null, zero or hold a null or non-finite component, take no part; nor do vectors of another length than
    most have. Rows of the query's id are its own. Of rows that repeat an id with other vectors the nearest counts, as
    query and as candidate: the score is the least of any two of their vectors. Fewer candidates than ``k`` give as many
    rows; an empty table none.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = lengths[0][0]
    rows = rows.filter(F.size("v") == d)
    index = fit(rows, lengths[0][1])
    queries = cut(rows.filter(is_query).select("id", "v").distinct())
    single = isinstance(getattr(vectors.select(vector_col).schema[0].dataType, "elementType", None), FloatType)
    coded = cut(encode(rows, index, "float" if single else "double"))
    found = ranked(coded, queries, index, probes or max(LEAST_PROBES, index.probes), k, shortlist)
    exact = found.groupBy("qid", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
