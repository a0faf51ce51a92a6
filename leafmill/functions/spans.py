"""Matches with positions, and what is built on them. Offsets count code points from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<value:string,start:int,stop:int>>"
#: What JavaScript's \s holds; Java's holds ASCII only.
SPACE = r"\s   -     　﻿"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative ``op`` over an array of numbers, such as prefix sums.

    Each round combines every value with that 1, 2, 4, … places before it, so an array of n takes about log2(n) rounds, each linear.
    """

    def step(acc: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        n = F.size(acc) - by
        return F.concat(F.slice(acc, F.lit(1), by), F.zip_with(F.slice(acc, F.lit(1), n), F.slice(acc, by + 1, n), op))

    rounds = lambda v: F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size(v))
    return let(values, lambda v: F.aggregate(rounds(v), v, step))


def prefix_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def regex_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern as ``value, start, stop``; with ``group``, that group at its first place in the match.

    Positions are prefix sums of the lengths of the matches and of the gaps between them: no Python, and no work that grows
    with the square of the number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), value.alias("value"))

    def found(x: Column) -> Column:
        ends = prefix_sums(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["whole"])), x["whole"], lambda g, w: F.length(g) + F.length(w)))
        if not group:
            return F.zip_with(x["whole"], ends, lambda w, e: F.struct(w.alias("value"), (e - F.length(w)).alias("start"), e.alias("stop")))
        rows = F.zip_with(F.arrays_zip(x["whole"].alias("w"), x["value"].alias("v")), ends, lambda r, e: F.struct(r["v"].alias("v"), (e - F.length(r["w"]) + F.instr(r["w"], r["v"]) - 1).alias("at")))
        return F.transform(rows, lambda r: F.struct(r["v"].alias("value"), r["at"].alias("start"), (r["at"] + F.length(r["v"])).alias("stop")))

    # most texts have no match, and are gone through once
    return F.when(text.rlike(pattern), let(both, found).cast(SPAN)).otherwise(F.array().cast(SPAN))


def guarded(text: Column, needed: Column, spans: Column) -> Column:
    """``spans`` only where the cheap test ``needed`` holds; else none."""
    return F.when(F.coalesce(needed, F.lit(False)), spans).otherwise(F.array().cast(SPAN))


def shrink_until(value: Column, valid: Callable[[Column], Column]) -> Column:
    """The longest of the value and its prefixes that end before a space that is valid; else null."""
    prefixes = lambda parts: F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.trim(F.array_join(F.slice(parts, 1, n), " ")))
    return F.get(F.filter(let(F.split(value, " ", -1), prefixes), valid), F.lit(0))


#: A text is cut by places in pieces of so many characters, as a place in one long string is found by going through it from its start.
PIECE = 256


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, stop: Column) -> Column:
    """What stands from ``start`` to ``stop`` in the text of ``pieces``, in time that does not depend on the text's length."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((stop - 1) / PIECE).cast("int")

    def own(k: Column) -> Column:
        begin = F.greatest(start - k * PIECE, F.lit(0))
        return F.substring(F.get(parts, k), begin + 1, F.least(stop - k * PIECE, F.lit(PIECE)) - begin)

    return F.when(stop > start, F.array_join(F.transform(F.sequence(first, last), own), "")).otherwise(F.lit(""))


def context(parts: Column, length: Column, start: Column, stop: Column, n: int = 32) -> Column:
    """``…before[[value]]after…`` with up to ``n`` characters of a text of ``length`` in ``pieces`` on either side and white space as single spaces."""
    shown = F.concat(
        F.when(start > n, F.lit("…")).otherwise(""), cut(parts, F.greatest(start - n, F.lit(0)), start), F.lit("[["), cut(parts, start, stop), F.lit("]]"),
        cut(parts, stop, F.least(stop + n, length)), F.when(stop + n < length, F.lit("…")).otherwise(""),
    )
    return F.regexp_replace(shown, f"[{SPACE}]+", " ")


def mask_spans(text: Column, spans: Column, mask: str = "[removed]") -> Column:
    """The text with every span, sorted and not overlapping, replaced by ``mask``; what stands between them is cut and joined once."""

    def masked(s: Column) -> Column:
        def kept(parts: Column) -> Column:
            before = F.transform(s, lambda x, k: cut(parts, F.coalesce(F.get(s, k - 1)["stop"], F.lit(0)), x["start"]))
            return F.array_join(F.concat(before, F.array(cut(parts, F.element_at(s, -1)["stop"], F.length(text)))), mask)

        return F.when(F.size(s) > 0, let(pieces(text), kept)).otherwise(text)

    return let(spans, masked)


def _first_come(spans: Column) -> Column:
    """Spans of which each overlaps another, in order of priority, without those that overlap an earlier one."""
    clash = lambda s: lambda m: (s["start"] < m["stop"]) & (s["stop"] > m["start"])
    return F.aggregate(spans, F.filter(spans, lambda s: F.lit(False)), lambda acc, s: F.when(F.exists(acc, clash(s)), acc).otherwise(F.concat(acc, F.array(s))))


def resolve_overlaps(spans: Column) -> Column:
    """Spans in order of priority, without those that overlap an earlier one, sorted by start.

    A sweep over the spans in order of their starts parts them where none reaches over a start; only within such a part
    are spans compared with each other.
    """

    def swept(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["span"]["stop"]), lambda a, b: F.greatest(a, b))
        begins = lambda r: F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (x["span"]["start"] >= F.get(r, k - 1)), k)), lambda k: k.isNotNull())

        def parts(b: Column) -> Column:
            own = lambda at, k: F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at)
            plain = lambda part: F.transform(part, lambda x: x["span"])
            by_priority = lambda part: F.array_sort(part, lambda x, y: x["no"] - y["no"])
            one = lambda part: F.when(F.size(part) == 1, plain(part)).otherwise(F.array_sort(_first_come(plain(by_priority(part))), lambda x, y: x["start"] - y["start"]))
            return F.flatten(F.transform(F.transform(b, own), one))

        return let(let(reach, begins), parts)

    numbered = lambda every: F.transform(every, lambda s, k: F.struct(s["start"].alias("at"), k.alias("no"), s.alias("span")))
    return let(spans, lambda every: F.when(F.size(every) > 1, let(F.array_sort(numbered(every)), swept)).otherwise(every))
