"""Word-by-word comparison of two versions, for many pairs at once.

A pair is cut into gaps where it is: by its common start and end and the longest rising chain of words that stand once on both
sides. Gaps are rows of their own, so that a long pair is dealt over many tasks: only what differs is shuffled, and reaches
the helper that finds a least script of edits.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.spans import SPACE

# Marks that count as one, and how many edits a gap may take before it is one replacement.
UNIFIED = str.maketrans({**dict.fromkeys("‘’‚′", "'"), **dict.fromkeys("“”„″", '"'), **dict.fromkeys("‐‑‒–—―−", "-"), "­": None})
MOST_EDITS = 1500
#: White space as Java has it in ``SPACE``.
WHITE = re.compile("[" + SPACE.replace(r"\s", r" \t\n\x0b\f\r") + "]+")
#: Pairs whose words a task holds at a time.
GAP_ROWS = 100
GAP = "a0 int, b0 int, wa array<string>, wb array<string>, pa array<int>, pb array<int>"
CHANGE = "kind string, a_from int, a_to int, b_from int, b_to int, before string, after string, before_page int, after_page int"


def _key(word: str) -> str:
    return unicodedata.normalize("NFKC", word).translate(UNIFIED)


def _folded(words: pa.Array) -> pa.Array:
    flat = [None if w is None else _key(w) for w in words.flatten().to_pylist()]
    sizes = words.value_lengths().to_pylist()
    ends = np.cumsum([0, *(n or 0 for n in sizes)]).tolist()
    starts = [None if n is None else e for n, e in zip(sizes, ends)] + ends[-1:]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.string()))


#: Called nondeterministic so that Spark works it out once, and no filter that uses it is moved below it.
_keys = F.arrow_udf(_folded, T.ArrayType(T.StringType())).asNondeterministic()


def page_words(text: Column) -> Column:
    """``page, word`` of the words of a text; pages, from 0, end at form feeds. Null has none."""
    words = lambda t: F.filter(F.split(t, f"[[^!-~]&&[{SPACE}]]+"), lambda w: w != "")  # noqa: E731  most characters fail the first test
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\f"), lambda t, i: F.transform(words(t), lambda w: F.struct(i.cast("int").alias("page"), w.alias("word")))))


def keys_of(words: Column) -> Column:
    """The forms in which words are compared: compatible characters folded, quotes and dashes made one. Only rows with words beyond
    ASCII hand these to Python."""
    return F.coalesce(_keys(F.when(F.exists(words, lambda w: w.rlike("[^\\x00-\\x7F]")), words)), words)


def prepared(pairs: DataFrame) -> DataFrame:
    """``pair, a, b, pa, pb, wa, wb, head, tail``: keys, pages and words of both sides, and how many words they have in common at their ends."""
    df = pairs.select("pair", page_words(F.col("before")).alias("_a"), page_words(F.col("after")).alias("_b"))
    df = df.select("pair", *[F.col(f"_{s}.{c}").alias(f"{n}{s}") for s in "ab" for n, c in (("p", "page"), ("w", "word"))])
    df = df.select("*", keys_of(F.col("wa")).alias("a"), keys_of(F.col("wb")).alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))

    def alike(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False))), F.lit(False))
        return F.when(first > 0, first - 1).otherwise(F.size(x)).cast("int")

    df = df.withColumn("head", F.least(alike(F.col("a"), F.col("b")), shorter))
    return df.withColumn("tail", F.least(alike(F.reverse("a"), F.reverse("b")), shorter - F.col("head")).cast("int"))


def unique_anchors(words: DataFrame) -> DataFrame:
    """``pair, key, a, b``: keys that stand exactly once on both sides of a pair (``pair, side, pos, key``), with their positions."""
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("pos")))
    n = lambda s: F.count_if(F.col("side") == s)
    once = words.groupBy("pair", "key").agg(n("a").alias("na"), n("b").alias("nb"), at("a").alias("a"), at("b").alias("b"))
    return once.filter("na = 1 and nb = 1").select("pair", "key", "a", "b")


def words_of(ready: DataFrame) -> DataFrame:
    """``pair, side, pos, key`` of the words between the common ends of ``prepared`` pairs."""
    inner = lambda c, s: F.transform(F.slice(c, F.col("head") + 1, F.size(c) - F.col("head") - F.col("tail")), lambda k, i: F.struct(F.lit(s).alias("side"), (i + F.col("head")).alias("pos"), k.alias("key")))
    return ready.select("pair", F.inline(F.concat(inner("a", "a"), inner("b", "b"))))


#: A path that left the two sequences.
OUTSIDE = -(1 << 40)


def rising(values: list[int]) -> list[int]:
    """The places of a longest strictly rising chain of ``values``."""
    ends, places, before = [], [], []
    for k, v in enumerate(values):
        at = bisect_left(ends, v)
        before.append(places[at - 1] if at else -1)
        ends[at : at + 1], places[at : at + 1] = [v], [k]
    out, k = [], places[-1] if places else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def least_script(a: np.ndarray, b: np.ndarray, most: int = MOST_EDITS) -> list[tuple[int, int]] | None:
    """The pairs of places that a least script of edits keeps (Myers 1986), or None if it takes more than ``most`` edits.

    The furthest reaching paths of one number of edits are moved on together, as arrays over their diagonals.
    """
    n, m, trail = len(a), len(b), []
    reach = np.zeros(1, np.int64)  # by diagonal -d, -d + 2, ..., d
    for d in range(min(n + m, most) + 1):
        k = np.arange(-d, d + 1, 2)
        if d:
            down = np.append(reach, OUTSIDE)  # an insertion, from the diagonal above
            across = np.append(OUTSIDE, reach + 1)  # a deletion, from the one below
            reach = np.where(down >= across, down, across)
        reach = np.where((reach < 0) | (reach > n) | (reach - k > m), OUTSIDE, reach)
        start, go = reach.copy(), reach >= 0
        while True:
            go &= (reach < n) & (reach - k < m)
            if not go.any():
                break
            at = np.flatnonzero(go)
            same = a[reach[at]] == b[reach[at] - k[at]]
            reach[at[same]] += 1
            go[at[~same]] = False
        trail.append((start, reach.copy()))
        end = n - m
        if abs(end) <= d and (end + d) % 2 == 0 and reach[(end + d) // 2] == n:
            break
    else:
        return None
    kept, k = [], n - m
    for d in range(len(trail) - 1, -1, -1):
        start, reach = trail[d]
        i = (k + d) // 2
        kept += [(x, x - k) for x in range(int(reach[i]) - 1, int(start[i]) - 1, -1)]
        if d:
            previous = trail[d - 1][1]
            down = previous[i] if i < d else OUTSIDE
            across = previous[i - 1] + 1 if i else OUTSIDE
            k += 1 if down >= across else -1
    return kept[::-1]


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The places kept between two sequences: equal ends, then words that stand once on each side, then a least script of what is between.

    The gaps are a list of work, so that depth costs no recursion.
    """
    kept, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            kept.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            kept.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        left, right = a[a0:a1].tolist(), b[b0:b1].tolist()
        n, m = Counter(left), Counter(right)
        place = {w: j for j, w in enumerate(right)}
        once = [(i, place[w]) for i, w in enumerate(left) if n[w] == 1 and m[w] == 1]
        chain = [once[k] for k in rising([j for _, j in once])]
        if chain:
            cuts = [(-1, -1), *chain, (a1 - a0, b1 - b0)]
            kept += [(a0 + i, b0 + j) for i, j in chain]
            work += [(a0 + i + 1, a0 + k, b0 + j + 1, b0 + l) for (i, j), (k, l) in zip(cuts, cuts[1:])]
        else:
            # words of one side alone are edits in any script
            own, other = [i for i, w in enumerate(left) if m[w]], [j for j, w in enumerate(right) if n[w]]
            most = MOST_EDITS - (len(left) - len(own)) - (len(right) - len(other))
            found = least_script(a[a0:a1][own], b[b0:b1][other], most) if own else None
            kept += [(a0 + own[i], b0 + other[j]) for i, j in found or []]
    return sorted(kept)


def split_words(text: str | None) -> tuple[list[str], list[int]]:
    """The words of a text and their pages, as ``page_words`` has them."""
    words, pages = [], []
    for page, part in enumerate((text or "").split("\f")):
        own = [w for w in WHITE.split(part) if w]
        words += own
        pages += [page] * len(own)
    return words, pages


class Codes(dict):
    """Numbers of words, equal where their keys are; a word's key is worked out once."""

    def __init__(self) -> None:
        self.keys_: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        code = self[word] = self.keys_.setdefault(word if word.isascii() else _key(word), len(self.keys_))
        return code


def codes_of(*sides: list[str]) -> list[np.ndarray]:
    """The keys of words as numbers, equal where the keys are."""
    codes = Codes()
    return [np.fromiter(map(codes.__getitem__, words), np.int64, len(words)) for words in sides]


def cuts_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of both sides that are kept, one before and one behind all that may differ among them: common ends and the longest
    rising chain of keys that stand exactly once on both sides between these."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    unlike = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = min(n - 1 - int(unlike[-1]) if len(unlike) else n, n - head)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    most = 1 + max(x.max(initial=0), y.max(initial=0))
    once = (np.bincount(x, minlength=most) == 1) & (np.bincount(y, minlength=most) == 1)
    place = np.zeros(most, np.int64)
    place[y] = np.arange(len(y))
    left = np.flatnonzero(once[x])
    right = place[x[left]]
    chain = rising(right.tolist())
    return tuple(np.concatenate([[head - 1], head + side[chain], [len(own) - tail]]).astype(np.int64) for side, own in ((left, a), (right, b)))


def gaps(pairs: DataFrame) -> DataFrame:
    """``pair, a0, b0, wa, wb, pa, pb`` of the stretches between anchors in which the sides of ``pairs`` differ.

    Each row is cut where it is, and only what differs goes on. ``pa`` and ``pb`` go one word further than the stretch, where there is one, and begin one
    word before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, GAP_ROWS) for b in batches for k in range(0, b.num_rows, GAP_ROWS)):
            out: list[tuple] = []
            for k, (before, after) in enumerate(zip(batch.column(1), batch.column(2))):
                (wa, pages_a), (wb, pages_b) = split_words(before.as_py()), split_words(after.as_py())
                ca, cb = cuts_of(*codes_of(wa, wb))
                for g in np.flatnonzero((np.diff(ca) > 1) | (np.diff(cb) > 1)):
                    a0, a1, b0, b1 = int(ca[g]) + 1, int(ca[g + 1]), int(cb[g]) + 1, int(cb[g + 1])
                    out.append((k, a0, b0, wa[a0:a1], wb[b0:b1], pages_a[max(a0 - 1, 0) : a1 + 1], pages_b[max(b0 - 1, 0) : b1 + 1]))
            keys = batch.column(0).take(pa.array([r[0] for r in out], pa.int64()))
            kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.string())] * 2, *[pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[c + 1] for r in out], t) for c, t in enumerate(kinds))], names=["pair", *(c.split()[0] for c in GAP.split(", "))])

    return pairs.select("pair", "before", "after").mapInArrow(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, {GAP}")


def word_diff(pairs: DataFrame) -> DataFrame:
    """``pair`` and the columns of ``CHANGE`` for every change of every pair ``pair, before, after``; ``pair`` is unique.

    A change is ``added``, ``removed`` or ``changed``; positions count words from 0, pages (ended by form feeds) from 0. Of words that were only
    added or only removed, the page on the other side is that of the word that follows, or of the last one. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, g in enumerate(batch.drop_columns(["pair"]).to_pylist()):
                a, b = codes_of(g["wa"], g["wb"])
                kept = [(-1, -1), *matched(a, b), (len(a), len(b))]
                for (i, j), (u, v) in zip(kept, kept[1:]):
                    if u > i + 1 or v > j + 1:
                        kind = "changed" if u > i + 1 and v > j + 1 else "removed" if u > i + 1 else "added"
                        before, after = g["wa"][i + 1 : u], g["wb"][j + 1 : v]
                        pages = [p[min(x + 1 + (g[f"{s}0"] > 0), len(p) - 1)] if p else 0 for s, p, x in (("a", g["pa"], i), ("b", g["pb"], j))]
                        out.append((k, kind, g["a0"] + i + 1, g["a0"] + u, g["b0"] + j + 1, g["b0"] + v, " ".join(before), " ".join(after), *pages))
            kinds = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32(), pa.int32()]
            keys = batch.column("pair").take(pa.array([r[0] for r in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[c + 1] for r in out], t) for c, t in enumerate(kinds))], names=["pair", *(c.split()[0] for c in CHANGE.split(", "))])

    dealt = gaps(pairs).repartition("pair", "a0")
    return dealt.mapInArrow(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, {CHANGE}")


def comparison_summary(pairs: DataFrame) -> DataFrame:
    """Words before, after and unchanged, and changes by kind, of each pair."""
    d = word_diff(pairs).groupBy("pair").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed")], F.sum(F.col("a_to") - F.col("a_from")).alias("gone"))
    n = [F.size(page_words(F.col(c))).cast("long").alias(a) for c, a in (("before", "words_before"), ("after", "words_after"))]
    out = pairs.select("pair", *n).join(d, "pair", "left").fillna(0, ["added", "removed", "changed", "gone"])
    return out.withColumn("unchanged", F.col("words_before") - F.col("gone")).drop("gone")


def changes_report(changes: DataFrame) -> DataFrame:
    """``pair, changes, text``: the number of changes of each pair and a line for each of them, in order."""
    page = lambda c: (F.col(c) + 1).cast("string")
    added = F.concat(F.lit("Added (page "), page("after_page"), F.lit("): "), "after")
    removed = F.concat(F.lit("Removed (page "), page("before_page"), F.lit("): "), "before")
    changed = F.concat(F.lit("Changed (page "), page("before_page"), F.lit(" → "), page("after_page"), F.lit("): "), "before", F.lit(" → "), "after")
    line = F.when(F.col("kind") == "added", added).when(F.col("kind") == "removed", removed).otherwise(changed)
    lines = F.array_sort(F.collect_list(F.struct("a_from", "b_from", line.alias("line"))))
    return changes.groupBy("pair").agg(F.count("*").alias("changes"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def rebuilt(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """``pair, text``: the words of ``after`` with single spaces, made from ``before`` and the changes alone."""
    ops = changes.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("a_from", "a_to", "after"))).alias("ops"))
    words = F.transform(page_words(F.col("before")), lambda w: w["word"])
    df = pairs.select("pair", words.alias("w")).join(ops, "pair", "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, op: Column) -> Column:
        same = F.slice("w", acc["at"] + 1, op["a_from"] - acc["at"])
        return F.struct(op["a_to"].alias("at"), F.concat(acc["out"], same, F.filter(F.array(op["after"]), lambda t: t != "")).alias("out"))

    none = F.array().cast("array<struct<a_from:int,a_to:int,after:string>>")
    whole = F.aggregate(F.coalesce("ops", none), start, step, lambda acc: F.concat(acc["out"], F.slice("w", acc["at"] + 1, F.size("w"))))
    return df.select("pair", F.array_join(whole, " ").alias("text"))


def version_pairs(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each row with the one before it in its group, as ``pair, before, after``."""
    w = Window.partitionBy(key).orderBy(order)
    lag = rows.select(F.struct(F.col(key).alias("key"), F.col(order).alias("at")).alias("pair"), F.lag(text).over(w).alias("before"), F.col(text).alias("after"))
    return lag.filter("before is not null").withColumn("pair", F.concat_ws("-", "pair.key", "pair.at"))
