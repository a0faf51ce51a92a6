"""Language identification (operator 13): rank-order profiles compared by out-of-place distance.

A text's words are its runs of letters, in lower case; its n-grams are the one to ``GRAM`` characters long stretches of
its words, each word between two blanks. A language's profile is the list of its ``PROFILE`` most frequent n-grams,
ties by code point, counted over the texts that are marked with it. A text's own list is made the same way from all of it; n-grams
of equal count share a rank. The distance to a language is the sum of the differences of ranks, and ``PROFILE`` for each
n-gram that the language's list lacks; the nearest language is the answer, ties to the smaller name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import in_python, small

GRAM, PROFILE = 3, 300
#: A language's profile is counted over about so many of its rows at most, chosen by a hash of their ids.
SAMPLE_ROWS = 5_000
#: More languages than this are taken for a mistake: no list of languages is so long, and their profiles go to every task.
MOST_LANGUAGES = 10_000
#: n-grams of a language that a task of the count holds before it adds them up, and characters of a text that are counted at a time.
HELD_GRAMS, HELD_CHARACTERS = 500_000, 1 << 20
UNDETERMINED = "und"
#: A character's bits in the number that stands for an n-gram.
_BITS = 21


@dataclass
class Profiles:
    """``languages`` in order; ``grams``, sorted; ``ranks``: languages x grams, ``PROFILE`` where a language's list lacks one."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def tally(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``grams``, sorted, and how often each stands among them, or the sums of their ``counts``."""
    if counts is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
    total = np.diff(np.r_[first, len(grams)]) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return grams[first], total


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text as numbers in the order of their texts, and how often each stands in it."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    # each word between two blanks, one of which the next word shares
    c = np.where(is_letter, c, ord(" "))[is_letter | np.r_[False, is_letter[:-1]]]
    c = np.concatenate([[ord(" ")], c, [ord(" ")]]).astype(np.int64) if len(c) else np.empty(0, np.int64)
    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    for k in range(0, len(c), HELD_CHARACTERS):
        x = c[k : k + HELD_CHARACTERS + GRAM - 1]
        one, two = x[:-1], x[1:]
        begins, ends = one != ord(" "), two != ord(" ")
        last = len(x) < HELD_CHARACTERS + GRAM - 1
        if not last:  # a stretch belongs to the part where it begins
            one, two, begins, ends = one[:-1], two[:-1], begins[:-1], ends[:-1]
        pair = one << 2 * _BITS | two << _BITS
        three = x[2:][: len(pair)]
        grams = [one[begins] << 2 * _BITS, pair[begins | ends], (pair[: len(three)] | three)[ends[: len(three)]]]
        part = tally(np.concatenate(grams))
        held = tally(np.concatenate([held[0], part[0]]), np.concatenate([held[1], part[1]])) if k else part
    return held


def top(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` n-grams of greatest count, ties to the smaller one, and their ranks from 0; equal counts share the least rank."""
    order = np.lexsort((grams, -counts))[:most]
    n = counts[order]
    return grams[order], np.searchsorted(-n, -n)


def fit(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles of the languages in ``lang``, from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds.

    Of each language about ``rows`` rows at most are counted, whole. Rows without language or text teach nothing. A language
    none of whose counted rows has a letter is not learnt. Without any, there are no profiles.
    """
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn).select("doc_id", "text", "lang")
    share = own.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(rows)) / F.count("*")).alias("_share"))
    pick = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < F.col("_share") * (1 << 20)
    sample = own.join(small(share), F.col("lang") == F.col("_lang")).filter(pick).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = tally(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(gram_counts(text))
                if sum(len(x[0]) for x in held[lang]) > HELD_GRAMS:
                    held[lang] = [tally(*(np.concatenate(x) for x in zip(*held[lang])))]
            if sum(len(x[0]) for parts in held.values() for x in parts) > 4 * HELD_GRAMS:
                yield from given()
        yield from given()

    counted = in_python(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    listed = counted.withColumn("rank", rank - 1).filter(F.col("rank") < PROFILE)
    found = listed.select("lang", "gram", "rank").limit(MOST_LANGUAGES * PROFILE + 1).toArrow()
    if found.num_rows > MOST_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(set(found["lang"].to_pylist()))
    grams, at = np.unique(found["gram"].to_numpy(), return_inverse=True)
    ranks = np.full((len(languages), len(grams)), PROFILE, np.int32)
    place = {x: k for k, x in enumerate(languages)}
    ranks[[place[x] for x in found["lang"].to_pylist()], at] = found["rank"].to_numpy()
    return Profiles(languages, grams, ranks)


def nearest_language(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """The language of least distance, and 1 less that distance as a share of the greatest there can be."""
    grams, ranks = top(*gram_counts(text))
    if not len(grams) or not profiles.languages:
        return UNDETERMINED, 0.0
    at = np.minimum(np.searchsorted(profiles.grams, grams), len(profiles.grams) - 1)
    off = np.where(profiles.grams[at] == grams, np.abs(profiles.ranks[:, at] - ranks), PROFILE)
    off = np.where(profiles.ranks[:, at] < PROFILE, off, PROFILE).sum(1)
    best = int(off.argmin())
    return profiles.languages[best], 1 - float(off[best]) / (PROFILE * len(grams))


def identify(docs: DataFrame, profiles: Profiles, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each row's whole text and how near it is, from 0 to 1; columns of these names, in whatever case, are replaced.

    Null texts, texts without a letter, and all texts where nothing was learnt get ``UNDETERMINED`` and 0. Equal texts get equal
    answers; nothing but the text counts. Rows are kept as they are, repeated ones too. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest_language(t.as_py(), held.value) for t in batch.column(at)]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, lang, score])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return in_python(docs.select(*[f"`{c}`" for c in kept]), run, schema)
