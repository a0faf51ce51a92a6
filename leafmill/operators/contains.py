"""Which texts hold which of many needles: an inverted index of short stretches of characters, in place of every text against every needle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.spans import let

#: The index's stretches have so many characters, or as many as a shorter needle has.
GRAM = 3
#: So few needles are tried on every text; a table of at most so many rows of a short text is broadcast.
FEW, BROADCAST_ROWS = 64, 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct stretches of a text of each of these sizes; of size 0 the empty one. Time and memory grow with the text's length alone."""
    def of(chars: Column, size: int) -> Column:
        if not size:
            return F.array(F.lit(""))
        stretch = lambda k: F.concat(*[F.get(chars, k + j) for j in range(size)])
        return F.when(F.size(chars) >= size, F.transform(F.sequence(F.lit(0), F.size(chars) - size), stretch)).otherwise(F.array().cast("array<string>"))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return let(chars, lambda c: F.array_distinct(F.flatten(F.array(*[of(c, s) for s in sizes]))))


def _has_words(needle: Column) -> Column:
    """Whether a needle's first space stands between two words."""
    return needle.rlike("^[^ ]+ [^ ]")


def _pairs(words: Column) -> Column:
    """The pairs of neighbours of an array of words."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, k: F.struct(w.alias("_a"), F.get(words, k + 1).alias("_b")))


def _ends(pairs: DataFrame, asked: DataFrame, word: str, own: str, suffix: bool) -> DataFrame:
    """``word, own`` of the texts' words that end (or begin) with a needle's word; only lengths that these have are cut off."""
    sizes = sorted(r[0] for r in asked.select(F.length(own)).distinct().collect())  # so few: together they are no longer than the needles
    cut = F.right if suffix else F.left
    ends = F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length(word)), lambda n: cut(F.col(word), n))
    return pairs.select(word).distinct().select(word, F.explode(ends).alias(own)).join(small(asked.select(own).distinct()), own, "left_semi")


def _by_words(texts: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``_needle`` for needles with a word on both sides of their first space: where one stands, a word of the text ends with
    its first and the next one begins with its second. So words meet by equality, and work grows with the texts' words and what is found."""
    from leafmill.operators.tables import cut as written

    rows = texts.filter(F.col(text).isNotNull()).withColumn("_row", F.monotonically_increasing_id()).transform(written)
    keyed = rows.select("_row", F.inline(let(F.split(text, " "), _pairs)))
    parts = written(asked.select("_needle", F.split("_needle", " ").alias("_w")).select("_needle", F.get("_w", F.lit(0)).alias("_first"), F.get("_w", F.lit(1)).alias("_second")))
    pairs = written(keyed.select("_a", "_b").distinct())
    hits = pairs.join(small(_ends(pairs, parts, "_a", "_first", True)), "_a").join(small(_ends(pairs, parts, "_b", "_second", False)), "_b").join(small(parts), ["_first", "_second"])
    found = keyed.join(hits.select("_a", "_b", "_needle"), ["_a", "_b"]).select("_row", "_needle").distinct()
    return rows.join(found, "_row").filter(F.contains(F.col(text), F.col("_needle"))).drop("_row")


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Each row of ``texts`` with each row of ``needles`` whose ``needle`` stands in its ``text``; both tables' columns, which must differ.

    A needle of two words or more is looked up by these. Any other is by that of its stretches that the fewest texts hold, so the join is by
    equality, and what it finds is verified.
    Null texts and needles meet nothing; an empty needle stands in every text. A few needles are tried on every text instead.
    """
    if needles.limit(FEW + 1).count() <= FEW:
        return texts.join(F.broadcast(needles), F.contains(F.col(text), F.col(needle)))
    asked = needles.filter(F.col(needle).isNotNull()).select(F.col(needle).alias("_needle")).distinct()
    worded = _has_words(F.col("_needle"))
    found = _by_words(texts, asked.filter(worded), text)
    asked = asked.filter(~worded)
    if asked.limit(1).count():
        found = found.unionByName(_by_stretches(texts, asked, text))
    return found.join(small(needles), F.col("_needle") == F.col(needle)).drop("_needle")


def _by_stretches(texts: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``_needle`` for any needles, by stretches of characters."""
    sizes = sorted(r[0] for r in asked.select(F.least(F.length("_needle"), F.lit(GRAM))).distinct().collect())  # at most GRAM + 1
    own = F.coalesce(*[F.when(F.least(F.length("_needle"), F.lit(GRAM)) == s, grams(F.col("_needle"), [s])) for s in sizes])
    wanted = asked.select("_needle", F.explode(own).alias("_gram"))
    keyed = texts.filter(F.col(text).isNotNull()).withColumn("_gram", F.explode(grams(F.col(text), sizes)))
    held = keyed.select("_gram").join(small(wanted.select("_gram").distinct()), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(held, "_gram", "left").groupBy("_needle").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return keyed.join(small(rarest), "_gram").filter(F.contains(F.col(text), F.col("_needle"))).drop("_gram")
