"""Periodic run detection (operator 11): a suffix automaton whose link tree is accessed word by word.

A run is a stretch of words with smallest period q, at least ``2 * q`` long, that no neighbouring word extends with that
period. The words of a stretch are numbered and put into a suffix automaton. Its states' link tree has a path for every
prefix: the states of the prefix's ends, the longer the deeper. Appending word e accesses that path: all states on it last
occur at e from now on. Before it is recoloured, the path falls into segments, each of states that last occurred at one
earlier place p; the longest state of a segment is how far the words before p and before e agree. Where that length
is no less than the distance e - p, the words to e hold a square of period e - p, and its period is a smallest one, as no
later occurrence is nearer. The length also tells where the run begins; further words extend it to its end.

As the tree of the whole stretch is known before the first access, its preferred paths need no rotations: it is cut into heavy
paths, and each keeps its segments, of which an access takes the upper ones, as a stack. An access meets O(log n) heavy
paths and takes off what earlier ones have put on: O(n log n) for n words.

Words in no run cost less. In a run at most 5 words in a row do not begin six words that stand twice in the run, so
stretches without such repeats are left out before, by sorted hashes of six words. That filter only leaves out; it finds no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafmill.llm.common import in_python, pieces

#: A run has so many words at least.
LEAST = 12
#: The filter's stretch of words, at most ``LEAST`` / 2; how often it is applied to what it has left.
STRETCH, PASSES = 6, 8

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def link_tree(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of ``words``: its states' lengths and suffix links, and the state of each prefix. State 0 is the root."""
    length, link, after = [0], [-1], [{}]
    last, ends = 0, []
    for i, word in enumerate(words):
        state, at = len(length), last
        length.append(i + 1)
        link.append(0)
        after.append({})
        while at >= 0 and word not in after[at]:
            after[at][word] = state
            at = link[at]
        if at >= 0:
            to = after[at][word]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                after.append(after[to].copy())
                while at >= 0 and after[at].get(word) == to:
                    after[at][word] = copy
                    at = link[at]
                link[to] = link[state] = copy
        last = state
        ends.append(state)
    return length, link, ends


def heavy_heads(length: list[int], link: list[int]) -> list[int]:
    """For each state the upper end of its heavy path, which goes on from a state to the child with most states below it."""
    order = np.argsort(np.array(length), kind="stable").tolist()  # parents are shorter
    below, heavy = [1] * len(length), [-1] * len(length)
    for v in reversed(order[1:]):
        up = link[v]
        below[up] += below[v]
        if heavy[up] < 0 or below[v] > below[heavy[up]]:
            heavy[up] = v
    head = list(range(len(length)))
    for v in order[1:]:
        if heavy[link[v]] == v:
            head[v] = head[link[v]]
    return head


def all_runs(words: list[int]) -> dict[tuple[int, int], int]:
    """The last word of every run of ``words``, of whatever length, by its start and period."""
    length, link, ends = link_tree(words)
    head = heavy_heads(length, link)
    #: of a heavy path, by its upper end: segments as (length of the longest state, last end), the upper ones last
    stacks: dict[int, list[tuple[int, int]]] = {}
    runs: dict[tuple[int, int], int] = {}
    for e, state in enumerate(ends):
        below = -1  # the last end of the segment just below
        while state > 0:
            top, reach = head[state], length[state]
            stack = stacks.setdefault(top, [])
            upper = stack[-1][1] if stack else -1
            while stack:
                longest, p = stack[-1]
                if longest <= reach:
                    stack.pop()
                    whole = stack and longest < reach  # another segment of this path lies below
                else:
                    longest, whole = reach, False
                if longest >= e - p and (whole or p != below):  # one that goes on below has been met there, in full length
                    runs[p - longest + 1, e - p] = e
                if longest == reach:
                    break
            stack.append((reach, e))
            state, below = link[top], upper
    return runs


def repetitive(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) of a text, given its words' numbers, that hold all its runs of ``LEAST`` words or more."""
    out, todo = [], [(0, len(ids), PASSES)]
    while todo:
        begin, end, left = todo.pop()
        if end - begin < LEAST:
            continue
        h = np.zeros(end - begin - STRETCH + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(STRETCH):
                h = (h ^ ids[begin + k : begin + k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        if not len(at):
            continue
        # in a run at most STRETCH - 1 places of a row do not begin a stretch that stands again
        breaks = np.flatnonzero(np.diff(at) > STRETCH)
        parts = [(begin + int(at[a]), begin + int(at[b]) + STRETCH) for a, b in zip(np.r_[0, breaks + 1], np.r_[breaks, len(at) - 1])]
        if left == 0 or parts == [(begin, end)]:
            out += [p for p in parts if p[1] - p[0] >= LEAST]
        else:
            todo += [(*p, left - 1) for p in parts]
    return sorted(out)


def find_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of ``words`` of ``least`` (``LEAST`` or more) words at least, by start, then period."""
    if len(words) < LEAST:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    found = [(begin, run) for begin, end in repetitive(np.array(ids, np.uint64)) for run in all_runs(ids[begin:end]).items()]
    out = [(begin + start, last - start + 1, period) for begin, ((start, period), last) in found if last - start + 1 >= least]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each row's whole text, and the text without their repetitions; columns of these names, in whatever case, are replaced.

    Words are what stands between white space (space, and tab to carriage return), told apart byte by byte and numbered from 0. ``runs`` is
    an array of (start, length, period) in words, by start, then period, of the runs of ``least`` words (``LEAST`` or more) and twice
    their period at least. ``collapsed`` has the words that no run contains after its first period, joined by one space; it is
    empty for null, empty and blank texts, which have no runs. Rows are kept as they are, repeated ones too. No shuffle:
    a text is one task's, which holds about a kilobyte for each word of its repetitive stretches.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    kept = [c for c in docs.columns if c.lower() not in (runs.lower(), collapsed.lower())]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rest = [], []
            for text in batch.column(at):
                words = [w for piece in pieces((text.as_py() or "").encode("utf-8", "surrogatepass")) for w in piece.split()]
                own = find_runs(words, least)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                rest.append(b" ".join(kept_words(words, own)).decode("utf-8", "surrogatepass"))
            columns = [pa.array(found, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, runs, collapsed])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(runs, T._parse_datatype_string(RUN)), T.StructField(collapsed, T.StringType())])
    return in_python(docs.select(*[f"`{c}`" for c in kept]), run, schema)
