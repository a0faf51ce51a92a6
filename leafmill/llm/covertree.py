"""Hard-negative mining (operator 12): exact search for greatest inner products in cover trees over norm-augmented vectors.

Vectors are put on a grid of whole numbers. A further component makes all of them equally long, so that the inner product
with a query, which lacks that component, falls as the angle to it grows. The candidates are dealt to the nearest of a few
top centres, and each block of them gets a cover tree: a node's children are vectors of the node that are more than a
share of its covering radius apart, the first being its own centre; each other vector goes to the first child that covers it. The
angle to a node's centre, less and plus the node's covering radius, bounds the inner products below the node.

A search descends best first: of the open nodes those of greatest bound, some at a time. Nodes outside of every window of
scores, or that cannot reach the k-th score found in one, are skipped, and so are nodes without a wanted label. Leaves are
verified by whole numbers. An anchor is first sent to the blocks of greatest bound; the others are searched only where they can
still hold what counts.

The first search is for positives (rows of the anchor's label of greatest score). These make the windows of the second, which
is for negatives.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut

#: Vectors of a tree, and anchors that one task searches for at a time, about; most top centres, chosen from about so many rows.
BLOCK, ANCHORS, TOPS, SAMPLE_ROWS = 4_096, 4_096, 1_024, 20_000
#: A child's radius is at most its parent's divided by this; nodes of so few vectors are leaves.
SHRINK, LEAF = 1.5, 16
#: Open nodes that a search takes at a time; top centres whose blocks an anchor is sent to first.
AT_ONCE, FIRST = 128, 2
#: What rounding can take from an angle.
SLACK = 1e-6


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def bounds(products: np.ndarray, radius: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products below nodes whose centres have ``products``; ``most`` is the product of both lengths."""
    if most <= 0:
        return np.zeros(len(products)), np.zeros(len(products))
    angle = angles(products / most)
    slack = 1e-9 * most
    return most * np.cos(np.minimum(angle + radius + SLACK, np.pi)) - slack, most * np.cos(np.maximum(angle - radius - SLACK, 0)) + slack


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows of ``x`` with a component that makes them ``norm`` long, divided by it: unit vectors."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1) / norm


@dataclass
class Tree:
    """Nodes are numbers, the root 0, children of a node in a row. ``rows``: begin and end of a leaf's vectors; ``labels``: least and greatest label below."""

    ids: np.ndarray
    label: np.ndarray
    x: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    norm: float


def plant(ids: np.ndarray, label: np.ndarray, x: np.ndarray, norm: float) -> Tree:
    """The cover tree of the vectors ``x`` (rows of whole numbers), none longer than ``norm``."""
    unit = augmented(x, norm)
    single = unit.astype(np.float32)
    near = single @ single.T
    nodes: list[tuple[int, np.ndarray]] = [(0, np.arange(len(x)))]
    radius, children, rows, order = [], [], [], []
    at = 0
    while at < len(nodes):
        centre, own = nodes[at]
        r = float(angles(unit[own] @ unit[centre]).max())
        radius.append(r)
        at += 1
        least = np.float32(np.cos(r / SHRINK))
        if len(own) <= LEAF or (near[centre, own[own != centre]] >= least).all():  # also where single precision can't tell them apart
            children.append((0, 0))
            rows.append((len(order), len(order) + len(own)))
            order += own.tolist()
            continue
        begin, child = len(nodes), centre
        while len(own):
            inside = near[child, own] >= least
            inside |= own == child
            nodes.append((child, own[inside]))
            own = own[~inside]
            child = int(own[0]) if len(own) else child
        children.append((begin, len(nodes)))
        rows.append((0, 0))
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    centre = place[[c for c, _ in nodes]]
    labels = np.array([(label[own].min(), label[own].max()) for _, own in nodes])
    return Tree(ids[order], label[order], x[order], centre, np.array(radius), np.array(children), np.array(rows), labels, norm)


def spread(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def search(tree: Tree, own_id: int, own_label: int, q: np.ndarray, windows: np.ndarray, k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, greatest score) the ``k`` greatest scores in it and their ids, ties to the smaller id.

    Only vectors of the query's label count, or only those of other labels; rows of its own id never.
    """
    low, high = windows[:, 0].astype(np.float64), windows[:, 1].astype(np.float64)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
    most = float(np.sqrt((q.astype(np.float64) ** 2).sum())) * tree.norm
    float_q = q.astype(np.float64)

    def bounded(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those nodes that can hold what counts, with their greatest bounds."""
        a, b = tree.labels[nodes].T
        nodes = nodes[(a <= own_label) & (own_label <= b) if same else (a != own_label) | (b != own_label)]
        under, over = bounds(tree.x[tree.centre[nodes]].astype(np.float64) @ float_q, tree.radius[nodes], most)
        keep = ((over[:, None] >= low) & (under[:, None] <= high)).any(1)
        return np.stack([nodes[keep].astype(np.float64), under[keep]]), over[keep]

    nodes, over = bounded(np.array([0]))
    while nodes.shape[1]:
        if nodes.shape[1] > AT_ONCE:
            order = np.argpartition(-over, AT_ONCE)
            best, rest = order[:AT_ONCE], order[AT_ONCE:]
        else:
            best, rest = np.arange(nodes.shape[1]), np.empty(0, np.int64)
        now = nodes[0, best].astype(np.int64)
        nodes, over = nodes[:, rest], over[rest]
        rows = spread(*tree.rows[now].T)
        rows = rows[((tree.label[rows] == own_label) == same) & (tree.ids[rows] != own_id)]
        if len(rows):
            score, ids = tree.x[rows] @ q, tree.ids[rows]
            for w, (least, greatest) in enumerate(windows):
                fits = (score >= least) & (score <= greatest)
                if fits.any():
                    s, i = np.concatenate([found[w][0], score[fits]]), np.concatenate([found[w][1], ids[fits]])
                    first = np.lexsort((i, -s))[:k]
                    found[w] = (s[first], i[first])
                    if len(first) == k:
                        low[w] = max(low[w], s[first[-1]])
            keep = ((over[:, None] >= low) & (nodes[1][:, None] <= high)).any(1)
            nodes, over = nodes[:, keep], over[keep]
        below, above = bounded(spread(*tree.children[now].T))
        nodes, over = np.concatenate([nodes, below], axis=1), np.concatenate([over, above])
    return found


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


@dataclass
class Forest:
    """``trees``: ``top, part, tree`` by block. ``centres``: unit vectors of the top centres; ``radius``, ``parts``: how far their rows are, and how many blocks they have."""

    trees: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    norm: float


def forest(rows: DataFrame, norm: float, block: int = BLOCK) -> Forest:
    """The trees of ``id, label, v``, written to the shared folder. The top centres come from a bounded sample; every row is in a tree."""
    spark, total = rows.sparkSession, rows.count()
    tops = min(TOPS, -(-total // block))
    pick = F.pmod(F.xxhash64("id", F.lit("top")), F.lit(1 << 20)) < max(1, int(min(1.0, SAMPLE_ROWS / total) * (1 << 20)))
    first = rows.filter(pick).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(tops).toArrow()
    if not first.num_rows:  # a hash that picked none
        first = rows.select("v").limit(1).toArrow()
    centres = augmented(matrix(first["v"], first.num_rows), norm)
    held = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = augmented(matrix(batch.column(2), batch.num_rows), norm) @ held.value.T
                top = near.argmax(1)
                angle = angles(near[np.arange(len(top)), top])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top, pa.int32()), pa.array(angle)], names=["id", "label", "v", "top", "angle"])

    dealt = cut(rows.select("id", "label", "v").mapInArrow(deal, "id long, label long, v array<long>, top int, angle double"))
    radius, parts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for top, n, far in dealt.groupBy("top").agg(F.count("*"), F.max("angle")).collect():  # a row for each top centre
        radius[top], parts[top] = far, -(-n // block)
    shape = F.broadcast(spark.createDataFrame(list(enumerate(parts.tolist())), "top int, parts long"))
    dealt = dealt.join(shape, "top").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        x = matrix(group["v"], group.num_rows).astype(np.int64)[order]
        tree = plant(group["id"].to_numpy()[order], group["label"].to_numpy()[order], x, norm)
        return pa.table({"top": [key[0].as_py()], "part": [key[1].as_py()], "tree": pa.array([pickle.dumps(tree)], pa.binary())}, schema=pa.schema([("top", pa.int32()), ("part", pa.int32()), ("tree", pa.binary())]))

    trees = dealt.select("top", "part", "id", "label", "v").groupBy("top", "part").applyInArrow(grow, "top int, part int, tree binary")
    return Forest(cut(trees), centres, radius, parts, norm)


_ASK = "key long, id long, label long, q array<long>, low array<long>, high array<long>"


def routed(asks: DataFrame, wood: Forest, first: bool) -> DataFrame:
    """``top, part`` and ``asks`` (of ``_ASK``) for the blocks of the ``FIRST`` top centres of greatest bound; or for the other blocks that can hold what counts."""
    held = asks.sparkSession.sparkContext.broadcast((wood.centres[:, :-1], wood.radius, wood.parts, wood.norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, parts, norm = held.value
        for batch in batches:
            at, top, part = [], [], []
            low, high = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for k, q in enumerate(matrix(batch.column(3), batch.num_rows).astype(np.float64) if batch.num_rows else ()):
                most = float(np.sqrt((q * q).sum())) * norm
                under, over = bounds(centres @ q * norm, radius, most)
                keep = (over[:, None] >= np.array(low[k], np.float64)) & (under[:, None] <= np.array(high[k], np.float64))
                best = np.argsort(-over, kind="stable")
                chosen = best[:FIRST] if first else best[FIRST:]
                for t in chosen[keep[chosen].any(1)].tolist():
                    at += [k] * int(parts[t])
                    top += [t] * int(parts[t])
                    part += range(int(parts[t]))
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(top, pa.int32()), pa.array(part, pa.int32()), *(c.take(own) for c in batch.columns)], names=["top", "part", "key", "id", "label", "q", "low", "high"])

    return asks.mapInArrow(run, "top int, part int, " + _ASK)


def searched(sent: DataFrame, wood: Forest, sets: int, k: int, same: bool) -> DataFrame:
    """``key, id, window, score, found``: of each block that an ask is sent to, the ``k`` best of each window."""

    def work(trees: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if trees.num_rows and asks.num_rows:
            tree = pickle.loads(trees["tree"][0].as_py())
            q = matrix(asks["q"], asks.num_rows).astype(np.int64)
            for j, (key, own, label, low, high) in enumerate(zip(*(asks[c].to_pylist() for c in ("key", "id", "label", "low", "high")))):
                windows = np.array(list(zip(low, high)), np.int64).reshape(-1, 2)
                for w, (score, ids) in enumerate(search(tree, own, label, q[j], windows, k, same)):
                    for c, values in zip(out, ([key] * len(ids), [own] * len(ids), [w] * len(ids), score.tolist(), ids.tolist())):
                        c += values
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds)], names=["key", "id", "window", "score", "found"])

    keys = ["top", "part", "set"]
    trees = wood.trees.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    sent = sent.withColumn("set", F.pmod(F.xxhash64("key", "id"), F.lit(sets)).cast("int"))
    return trees.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(work, "key long, id long, window int, score long, found long")


def best(asks: DataFrame, wood: Forest, k: int, same: bool) -> DataFrame:
    """``key, id, window, rank, score, found``: the ``k`` best of each window of ``asks`` in the whole forest."""
    sets = max(1, -(-asks.count() // ANCHORS))
    ranked = F.row_number().over(Window.partitionBy("key", "id", "window").orderBy(F.desc("score"), "found"))
    near = cut(searched(routed(asks, wood, True), wood, sets, k, same).withColumn("rank", ranked).filter(F.col("rank") <= k))
    last = near.filter(F.col("rank") == k).groupBy("key", "id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
    asks = asks.join(last, ["key", "id"], "left").withColumn("low", F.transform("low", lambda x, w: F.coalesce(F.try_element_at("last", w.cast("int")), x)))
    far = searched(routed(asks.select("key", "id", "label", "q", "low", "high"), wood, False), wood, sets, k, same)
    every = near.drop("rank").unionByName(far)
    return cut(every.withColumn("rank", ranked).filter(F.col("rank") <= k))


def grid(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``id, label, v``: distinct rows with an id, a label, and a vector of finite components only, each made floor(``scale`` * component)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    # scores are summed and compared times 100 as long
    most = F.floor(F.sqrt(F.lit(float(1 << 56)) / F.size("v")))
    rows = rows.filter(~F.exists("v", lambda x: F.abs(x) * scale >= most))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256,
                   id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each row for which ``is_anchor`` (on ``id_col``) holds.

    A score is the inner product with the anchor of vectors whose components are floor(``scale`` * component). An anchor's positives are
    the first ``positives`` other rows of its label by greatest score, ties to the smaller id; the negatives of a positive the
    first ``negatives`` rows of other labels whose score is from ``window[0]`` to ``window[1]`` hundredths of the positive's.
    All of it is exact. A positive without negatives gives no row, nor does an anchor without positives; an empty table none.

    Rows without id or label take no part, nor do vectors that are null, empty or hold a null or non-finite component, vectors of
    another length than most have (ties: the shorter), or with a component so large that scores times 100 need not fit a long. Equal
    rows count once. An id that has several different rows has each of them as anchor and candidate; none of them is
    another row to the others. Of copies of one vector and label only the smallest ids can count, so only these are searched.
    """
    spark, k = vectors.sparkSession, max(positives, negatives)
    rows = grid(vectors, scale, id_col, label_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = cut(rows.filter(F.size("v") == lengths[0][0]))
    norm = max(1.0, rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()[0] ** 0.5)
    copy = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    # an anchor has at most one row of a label and vector
    wood = forest(cut(rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy")), norm, block)

    everything = (F.lit(-(1 << 62)), F.lit((1 << 62)))
    anchors = cut(rows.withColumnRenamed("id", id_col).filter(is_anchor).select(F.xxhash64("label", "v").alias("key"), F.col(id_col).alias("id"), "label", F.col("v").alias("q")))
    near = best(anchors.select("*", F.array(everything[0]).alias("low"), F.array(everything[1]).alias("high")), wood, positives, True)
    by_anchor = near.groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "found"))).alias("p"))  # at most ``positives``
    asks = anchors.join(by_anchor, ["key", "id"])
    # hundredths rounded up and down in whole numbers; windows of negative scores are empty
    asks = asks.withColumns({"low": F.expr(f"transform(p, p -> (p.score * {window[0]} + pmod(-p.score * {window[0]}, 100)) div 100)"),
                             "high": F.expr(f"transform(p, p -> (p.score * {window[1]} - pmod(p.score * {window[1]}, 100)) div 100)")}).drop("p")
    far = best(asks, wood, negatives, False)
    pairs = near.select("key", "id", (F.col("rank") - 1).alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(pairs, ["key", "id", "window"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
