"""Suffix-array dedup (operator 1): a distributed merge sort of suffixes that never compares a known prefix again.

Bytes covered by a ``span``-byte string that starts at least twice in the corpus are removed. Sorting every suffix is
not needed: a string of ``span`` bytes always holds an *anchor*, the least hash of its runs of ``CORE`` bytes, and equal
strings have equal anchors. So only the suffixes that begin at anchors are sorted, each with what stands before it.

1. Tasks find anchors, one row for each distinct surrounding in a batch; equal surroundings in a batch are settled there.
2. Anchors are dealt by their core's hash; those whose core occurs once in the corpus are dropped.
3. For the others, tasks cut the surroundings from the texts and sort them: a run is front-coded (length of the prefix
   shared with the suffix before, and the rest) and compressed. Runs are dealt by the hash of their cores.
4. A loser tree merges the runs of a part. Each run's head keeps the length of the prefix it shares with the last suffix
   that left the tree; heads are compared by these lengths, and by bytes only behind them.
5. The merged order with its common prefixes, and the order of what stands before the anchors, show for each offset
   of the anchor in a string whether the string occurs elsewhere. All strings that hold one anchor overlap, so an
   anchor gives one interval; a document's intervals are joined and cut out.

A core with more than ``HOT_ANCHORS`` anchors, as boilerplate of less than ``span`` bytes in very many documents has, would gather
in one part. For these anchors alone the strings around them are counted by 128-bit hashes, which is pre-aggregated and has no hot key
but true repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mix, shared_dir

SPAN = 200
CORE = 64
#: A longer text is searched in pieces of so many bytes that overlap.
PIECE = 1 << 20
#: Parts into which sorted runs are dealt, for each shuffle partition at least, and so many that a part has about so many anchors.
PARTS, PART_ANCHORS = 4, 100_000
#: A core with more anchors than this is not merged in one task: the strings around its anchors are counted by their hashes instead.
HOT_ANCHORS = 200_000
#: Rows of the result that a task hands on at a time, and rows in which it looks for equal surroundings.
ROWS, GATHER = 500, 10_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


class _Tables:
    up = down = np.empty(0, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n + 1:
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(text: bytes, span: int = SPAN, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, the hashes of their cores, and the hashes of their surroundings."""
    found = []
    before, n = span - core, len(text)
    for begin in range(0, n if n >= span else 0, PIECE):
        low, high = max(0, begin - 3 * span), min(n, begin + PIECE + 3 * span)
        if high - low < span:
            continue
        b = np.frombuffer(text, np.uint8, high - low, low).astype(np.uint64)
        _Tables.reach(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * _Tables.up[: len(b)], dtype=np.uint64)])
            h = mix((sums[core:] - sums[:-core]) * _Tables.down[: len(sums) - core])
            least = _sliding(np.minimum, h, before + 1)
            # an anchor equals the least of some window that holds it: the greatest of those windows' leasts
            padded = np.concatenate([np.zeros(before, np.uint64), least, np.zeros(before, np.uint64)])
            at = np.flatnonzero(_sliding(np.maximum, padded, before + 1) == h)
            at = at[(at + low >= begin) & (at + low < begin + PIECE)]
            left, right = np.maximum(at - before, 0), np.minimum(at + span, len(b))
            around = mix((sums[right] - sums[left]) * _Tables.down[left] ^ mix(((at - left) << 16 | (right - at)).astype(np.uint64), 3), 4)
        found.append((at + low, h[at], around))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(intervals):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least ``GATHER`` rows where there are so many, however small the session makes them: equal surroundings meet in a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def find_anchors(rows: DataFrame, span: int) -> DataFrame:
    """From ``doc_id, rk, text``: rows of anchors (``core, rk, pos``), and of settled intervals (``doc_id, rk, pos, stop``), whose core spreads them."""
    before = span - CORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            texts = [_bytes(t) for t in batch.column(2)]
            own = [anchors(t, span) for t in texts]
            doc = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
            pos, core, around = (np.concatenate([np.empty(0, k), *[x[j] for x in own]]) for j, k in enumerate((np.int64, np.uint64, np.uint64)))
            _, first, which, n = np.unique(around, return_index=True, return_inverse=True, return_counts=True)
            settled: dict[int, list[tuple[int, int]]] = {}
            extra, again = [], np.zeros(len(first), bool)
            for k in np.flatnonzero(n[which] > 1):
                j = first[which[k]]
                if k == j:
                    continue
                a, b, t, u = int(pos[k]), int(pos[j]), texts[doc[k]], texts[doc[j]]
                if t[max(0, a - before) : a + span] != u[max(0, b - before) : b + span]:
                    extra.append(k)  # another text of the same hash
                    continue
                if min(a, before) + min(span, len(t) - a) >= span:
                    settled.setdefault(int(doc[k]), []).append((max(0, a - before), min(len(t), a + span)))
                    if not again[which[k]]:
                        again[which[k]] = True
                        settled.setdefault(int(doc[j]), []).append((max(0, b - before), min(len(u), b + span)))
            keep = np.sort(np.concatenate([first, np.array(extra, np.int64)])).astype(np.int64)
            ids, rks = batch.column(0), batch.column(1)
            spans = [(d, *x) for d, i in settled.items() for x in joined(i)]
            mine = pa.array([s[0] for s in spans], pa.int64())
            at = pa.array(np.concatenate([doc[keep], np.array([s[0] for s in spans], np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(len(keep), pa.int64()), ids.take(mine)]),
                    rks.take(at),
                    pa.concat_arrays([pa.array(core[keep].view(np.int64)), rks.take(mine)]),
                    pa.array([True] * len(keep) + [False] * len(spans), pa.bool_()),
                    pa.array([*pos[keep].tolist(), *[s[1] for s in spans]], pa.int64()),
                    pa.array([*[None] * len(keep), *[s[2] for s in spans]], pa.int64()),
                ],
                names=["doc_id", "rk", "core", "anchor", "pos", "stop"],
            )

    return rows.mapInArrow(run, "doc_id long, rk long, core long, anchor boolean, pos long, stop long")


def encode_run(rows: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, reversed text before it, doc_id, rk, pos), front-coded and compressed. doc_id may be null."""
    suffixes = [r[0] for r in rows]
    shared = [0, *(common(a, b, 0) for a, b in zip(suffixes, suffixes[1:]))]
    numbers = np.array([(x, len(r[0]), len(r[1]), r[2] is None) for x, r in zip(shared, rows)], "<u2")
    keys = np.array([(r[2] or 0, r[3], r[4]) for r in rows], "<i8")
    parts = [np.array([len(rows)], "<i8").tobytes(), numbers.tobytes(), keys.T.tobytes(), b"".join(s[x:] for s, x in zip(suffixes, shared)), b"".join(r[1] for r in rows)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def decode_run(blob: bytes) -> tuple[list[int], list[bytes], list[bytes], list[tuple]]:
    """The common prefixes, suffixes, texts before them, and keys of a run."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    numbers = np.frombuffer(data, "<u2", 4 * n, 8).reshape(n, 4).tolist()
    keys = np.frombuffer(data, "<i8", 3 * n, 8 + 8 * n).reshape(3, n).T.tolist()
    at, last, suffixes, before = 8 + 32 * n, b"", [], []
    for x, size, _, _ in numbers:
        last = last[:x] + data[at : at + size - x]
        at += size - x
        suffixes.append(last)
    for _, _, size, _ in numbers:
        before.append(data[at : at + size])
        at += size
    return [x[0] for x in numbers], suffixes, before, [(None if x[3] else k[0], k[1], k[2]) for x, k in zip(numbers, keys)]


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two strings of which ``known`` bytes are known to agree."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most - 1  # the first difference is in [low, high]
    while low < high:
        mid = (low + high) // 2 + 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the suffix before) of the suffixes of sorted runs, in order, by a loser tree.

    ``lcp[r]``: the prefix that the head of run r shares with the last suffix that left the tree. Of two heads the one
    that shares more is smaller; only heads that share equally much are compared, behind what they share.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at, lcp = [0] * k, [0] * k
    heads: list[bytes | None] = [runs[r][1][0] if r < len(runs) and runs[r][1] else None for r in range(k)]
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one that it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        n = common(x, y, lcp[a])
        if n == len(x) and (n < len(y) or a < b) or n < len(x) and n < len(y) and x[n] < y[n]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    winners = list(range(k)) * 2
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(*((winners[2 * node], winners[2 * node + 1]) if 2 * node < k else (2 * node - k, 2 * node + 1 - k)))
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        yield top, at[top], lcp[top]
        at[top] += 1
        shared, suffixes = runs[top][0], runs[top][1]
        if at[top] < len(suffixes):
            heads[top], lcp[top] = suffixes[at[top]], shared[at[top]]
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node]) if heads[top] is not None or heads[losers[node]] is not None else (top, losers[node])
            node //= 2


def repeated(suffix_lcp: list[int], suffixes: list[int], before: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """By anchor, in suffix order, the least and greatest number of bytes before it in a string that occurs elsewhere.

    ``suffixes``: their lengths. Anchors without such a string have a least number above the greatest.
    """
    n = len(before)
    rest, lead = np.array(suffixes, np.int64), np.array([len(b) for b in before], np.int64)
    right = np.array(suffix_lcp, np.int64)
    order = sorted(range(n), key=before.__getitem__)
    left = np.zeros(n, np.int64)
    left[1:] = [common(before[a], before[b], 0) for a, b in zip(order, order[1:])]
    order = np.array(order)
    least, most = np.full(n, span), np.full(n, -1)
    for d in range(span - CORE + 1):
        can = np.flatnonzero((lead >= d) & (rest >= span - d))
        if len(can) < 2:
            continue
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(left < d)
        key = np.cumsum(right < span - d)[can] * (n + 1) + rank[can]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit = can[by[np.append(same, False) | np.append(False, same)]]
        least[hit] = np.minimum(least[hit], d)
        most[hit] = d
    return least, most


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, rk, text, spans`` of each row: the maximal byte runs ``start, stop`` to remove.

    ``rk`` is a hash of id and text, so that rows of one id keep apart; repeated rows are occurrences each.
    """
    before, spark = span - CORE, docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rk"), "text")
    # texts are large rows: more partitions than usual keep what a task holds of them small
    small = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = f"{shared_dir(spark)}/anchors-{uuid.uuid4().hex}"
    find_anchors(rows, span).write.parquet(where)
    found = spark.read.parquet(where)
    twice = found.filter("anchor").groupBy(F.col("core").alias("_core")).agg(F.count("*").alias("n")).filter("n > 1")
    marks = found.filter("anchor").join(twice, F.col("core") == F.col("_core")).select(F.col("rk").alias("_rk"), "pos", (F.col("n") > HOT_ANCHORS).alias("_hot"))
    at = lambda hot: F.collect_set(F.when(F.col("_hot") == F.lit(hot), F.col("pos")))
    chosen = marks.repartition(small, "_rk").groupBy("_rk").agg(at(False).alias("at"), at(True).alias("hot"))
    anchors, most = found.filter("anchor").count(), twice.agg(F.max("n")).first()[0] or 0
    parts = max(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), anchors // PART_ANCHORS)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_part: dict[int, list] = {}
            for doc, rk, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                text = _bytes(text)
                for p in at.as_py():
                    suffix = text[p : p + span]
                    part = xxhash.xxh3_64_intdigest(suffix[:CORE]) % parts
                    by_part.setdefault(part, []).append((suffix, text[max(0, p - before) : p][::-1], doc, rk, p))
            for rows in by_part.values():
                rows.sort(key=lambda r: r[:2])
            yield pa.RecordBatch.from_arrays([pa.array(list(by_part), pa.int32()), pa.array([encode_run(x) for x in by_part.values()], pa.binary())], names=["part", "run"])

    def merged(group: pa.Table) -> pa.Table:
        decoded = [decode_run(r.as_py()) for r in group["run"]]
        own = list(merge([(d[0], d[1]) for d in decoded]))
        least, most = repeated([x for _, _, x in own], [len(decoded[r][1][k]) for r, k, _ in own], [decoded[r][2][k] for r, k, _ in own], span)
        by_doc: dict[tuple, list[tuple[int, int]]] = {}
        for j in np.flatnonzero(most >= least):
            doc, rk, p = decoded[own[j][0]][3][own[j][1]]
            by_doc.setdefault((doc, rk), []).append((p - int(most[j]), p - int(least[j]) + span))
        out = [(*key, *x) for key, i in by_doc.items() for x in joined(i)]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc_id", "rk", "start", "stop"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, rk, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                text = _bytes(text)
                for p in at.as_py():
                    begins = range(max(0, p - before, p + CORE - span), min(p, len(text) - span) + 1)
                    if begins:
                        columns = [[doc] * len(begins), [rk] * len(begins), list(begins), [p - b for b in begins], [xxhash.xxh3_128_digest(text[b : b + span]) for b in begins]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "rk", "start", "lead", "h"])

    texts = rows.repartition(small, "rk")  # one exchange for both joins below
    cut_out = texts.join(chosen, F.col("rk") == F.col("_rk")).select("doc_id", "rk", "text", "at").mapInArrow(runs, "part int, run binary")
    if most > HOT_ANCHORS:
        # a string is the same string at another place if it is met twice with its anchor as far from its begin
        strings = f"{shared_dir(spark)}/strings-{uuid.uuid4().hex}"
        hot = texts.join(chosen.filter(F.size("hot") > 0), F.col("rk") == F.col("_rk")).select("doc_id", "rk", "text", "hot")
        hot.mapInArrow(windows, "doc_id long, rk long, start long, lead int, h binary").write.parquet(strings)
        hot = spark.read.parquet(strings)
        again = hot.groupBy(F.col("h").alias("_h"), F.col("lead").alias("_lead")).agg(F.count("*").alias("n")).filter("n > 1").select("_h", "_lead")
        found_hot = hot.join(again, (F.col("h") == F.col("_h")) & (F.col("lead") == F.col("_lead"))).groupBy("doc_id", "rk", (F.col("start") + F.col("lead")).alias("p"))
        found_hot = found_hot.agg(F.min("start").alias("start"), (F.max("start") + span).alias("stop")).select("doc_id", "rk", "start", "stop")
    hits = cut_out.groupBy("part").applyInArrow(merged, "doc_id long, rk long, start long, stop long")
    settled = found.filter("not anchor").select("doc_id", "rk", F.col("pos").alias("start"), "stop")
    own = F.struct(F.col("doc_id").alias("id"), "start", "stop")
    hits = hits.union(found_hot) if most > HOT_ANCHORS else hits
    spans = hits.union(settled).repartition(small, "rk").groupBy(F.col("rk").alias("_rk")).agg(F.collect_set(own).alias("_spans"))
    of_row = F.filter("_spans", lambda x: x["id"].eqNullSafe(F.col("doc_id")))
    return texts.join(spans, F.col("rk") == F.col("_rk"), "left").select("doc_id", "rk", "text", of_row.alias("spans"))


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for each row of ``doc_id, text``.

    Every byte covered by a string of ``span`` bytes that also starts anywhere else is removed, judged on the input.
    ``spans``: the maximal removed runs, ``start`` and ``stop`` as byte offsets in UTF-8; ``kept``: the bytes left, which
    need not be valid UTF-8. Null text is empty; texts shorter than ``span`` are kept whole; repeated rows of at least
    ``span`` bytes lose all; an empty table gives an empty result; null ids stay; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            sizes, spans, kept = [], [], []
            for text, own in zip(batch.column(1), batch.column(2)):
                data = _bytes(text)
                whole = joined([(x["start"], x["stop"]) for x in own.as_py() or []])
                edges = [0, *(e for x in whole for e in x), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in whole])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return repeated_spans(docs, span).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
