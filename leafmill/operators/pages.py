"""Algebra on a table of pages ``doc, page, ...``, pages from 0 without gaps in each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.ranges import bates_label, fill_template, pages_to_delete, parse_page_ranges
from leafmill.operators.tables import cut


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.count("*").alias("pages"))


#: Rows whose order values give the bounds of ranges, on average at most, for up to 256 ranges; more ranges have more.
SAMPLE = 10_000
#: A range has about so many rows at most, as one task sorts it; and there are so many ranges at most.
RANGE_ROWS, MOST_RANGES = 2_000_000, 1 << 14


def ranges_of(rows: DataFrame, order: str, total: int, buckets: int = 256) -> DataFrame:
    """``rows`` with ``_b``, the number of the range of ``order`` that each is in, from 0; null orders come first, as in a sort.

    Bounds are quantiles of a sample chosen by hash, so any type that sorts will do. They only even out the ranges, whose number grows with the rows.
    """
    buckets = max(buckets, min(MOST_RANGES, total // RANGE_ROWS))
    pick = F.pmod(F.xxhash64(order), F.lit(max(1, total // max(SAMPLE, 40 * buckets)))) == 0
    values = rows.filter(pick).agg(F.array_sort(F.collect_set(order)).alias("_v"))
    cuts = values.select(F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda k: F.get("_v", F.floor(k * F.size("_v") / buckets).cast("int"))).alias("_cuts"))
    # a binary search: the number of bounds below the row's order
    halves = F.array(*[F.lit(1 << k) for k in reversed(range((buckets - 1).bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda n, by: F.when(F.get("_cuts", n + by - 1) < F.col(order), n + by).otherwise(n))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("_b", below).drop("_cuts")


def prefix_sums(counts: DataFrame, order: str, value: str, out: str, by: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """``counts`` with ``out``, the sum of ``value`` over rows of smaller ``order``, of the same ``by`` where given.

    No window holds all rows, nor all rows of one ``by``: rows are dealt into ranges of ``order``; sums of ranges are added up, and each range is
    summed by itself.
    """
    by = by or []
    dealt = ranges_of(counts, order, counts.count(), buckets)
    sums = dealt.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    running = F.sum("_s").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_b").alias("_c"), F.coalesce(running, F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_b") == F.col("_c")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    joined = dealt.join(before if by else F.broadcast(before), same)  # without ``by`` a row for each range
    return joined.withColumn(out, (F.col("_before") + own).cast("long")).drop("_b", "_c", "_before", *[f"_by{k}" for k in range(len(by))])


def merge_docs(pages: DataFrame, order: str = "doc") -> DataFrame:
    """All pages as one document ``merged``: the documents one after another by ``order``, numbers or text, pages numbered on.

    One document merged with none is that document, and no document gives no pages; ``order`` is unique by document.
    """
    counts = pages.groupBy("doc").agg(F.first(order).alias("_order"), F.count("*").alias("_n"))
    at = prefix_sums(counts, "_order", "_n", "_at").select(F.col("doc").alias("_doc"), "_at")
    return pages.join(at, F.col("doc") == F.col("_doc")).withColumn("merged", F.col("_at") + F.col("page")).drop("_doc", "_at")


def extract_groups(pages: DataFrame, spec: Column) -> DataFrame:
    """A new document ``part`` for each part of the page list, its pages numbered as ``at``; documents whose list is bad give none."""
    parts = page_counts(pages).select(F.col("doc").alias("_doc"), F.posexplode(parse_page_ranges(spec, F.col("pages"))["groups"]).alias("part", "_group"))
    parts = parts.select("_doc", "part", F.posexplode("_group").alias("at", "_page"))
    return pages.join(parts, (F.col("doc") == F.col("_doc")) & (F.col("page") == F.col("_page"))).drop("_doc", "_page")


def split_every(pages: DataFrame, size: int) -> DataFrame:
    """Parts of ``size`` pages."""
    return pages.withColumn("part", F.floor(F.col("page") / size)).withColumn("at", F.col("page") % size)


def delete_pages(pages: DataFrame, spec: Column) -> DataFrame:
    """Without the listed pages, numbered anew as ``at``. A document whose list is bad, or names all its pages, stays whole."""
    counts = page_counts(pages).withColumn("_gone", pages_to_delete(spec, F.col("pages")))
    gone = counts.select(F.col("doc").alias("_doc"), F.when(F.size("_gone") < F.col("pages"), F.col("_gone")).otherwise(F.array().cast("array<bigint>")).alias("_gone"))
    kept = pages.join(gone, F.col("doc") == F.col("_doc")).filter(~F.array_contains("_gone", F.col("page").cast("bigint")))
    before = F.size(F.filter("_gone", lambda g: g < F.col("page")))
    return kept.withColumn("at", (F.col("page") - before).cast("long")).drop("_doc", "_gone")


def rearrange_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages by the list ``doc, page, at, turn``: others go, and ``rotation`` grows by ``turn``.

    A document's list is bad, and the document stays as it is, if it names a page twice or one that is not there, or a turn
    that is no multiple of 90.
    """
    lists = edits.groupBy("doc").agg(F.count("*").alias("n"), F.countDistinct("page").alias("d"), F.max("page").alias("hi"), F.min("page").alias("lo"), F.max(F.col("turn") % 90 != 0).alias("odd"))
    good = lists.join(page_counts(pages), "doc").filter((F.col("n") == F.col("d")) & (F.col("lo") >= 0) & (F.col("hi") < F.col("pages")) & ~F.col("odd")).select(F.col("doc").alias("_doc"))
    e = edits.join(good, F.col("doc") == F.col("_doc"), "left_semi").select(F.col("doc").alias("_d"), F.col("page").alias("_p"), "at", "turn")
    kept = pages.join(e, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p"))).withColumn("rotation", F.pmod(F.col("rotation") + F.col("turn"), F.lit(360)))
    rest = pages.join(good, F.col("doc") == F.col("_doc"), "left_anti").withColumn("at", F.col("page").cast("long"))
    return kept.select(*pages.columns, F.col("at").cast("long").alias("at")).unionByName(rest.select(*pages.columns, "at"))


def insert_pages(pages: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """``new`` (``doc, page``, other columns null where it has none) before page ``at`` of its document, clamped to its begin and end."""
    n = new.groupBy(F.col("doc").alias("_doc")).agg(F.count("*").alias("_n"))
    place = F.greatest(F.lit(0), F.least(F.lit(at), F.col("pages")))
    own = pages.join(page_counts(pages).select(F.col("doc").alias("_c"), "pages"), F.col("doc") == F.col("_c")).join(n, F.col("doc") == F.col("_doc"), "left")
    own = own.withColumn("at", (F.col("page") + F.when(F.col("page") >= place, F.coalesce("_n", F.lit(0))).otherwise(0)).cast("long")).select(*pages.columns, "at")
    added = new.join(page_counts(pages).select(F.col("doc").alias("_c"), "pages"), F.col("doc") == F.col("_c")).withColumn("at", (F.col("page") + place).cast("long")).drop("_c", "pages")
    return own.unionByName(added, allowMissingColumns=True)


def insert_blanks(pages: DataFrame, count: int, at: int) -> DataFrame:
    if not 1 <= count <= 500:
        raise ValueError("between 1 and 500 blank pages")
    blanks = page_counts(pages).select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("page"))
    return insert_pages(pages, blanks, at)


def rotate_pages(pages: DataFrame, chosen: Column, angle: int) -> DataFrame:
    if angle % 90:
        raise ValueError("a multiple of 90")
    return pages.withColumn("rotation", F.when(chosen, F.pmod(F.col("rotation") + angle, F.lit(360))).otherwise(F.col("rotation")))


def number_pages(pages: DataFrame, template: str = "{n} / {total}", start: int = 1, chosen: Column | None = None) -> DataFrame:
    """``label`` of each chosen page; the numbers run on over those that are not, which have none."""
    if "{n}" not in template:
        raise ValueError("the template needs {n}")
    chosen = F.lit(True) if chosen is None else chosen
    w = Window.partitionBy("doc").orderBy("page")
    n = F.sum(F.when(chosen, 1).otherwise(0))
    label = fill_template(F.lit(template), {"n": n.over(w) + start - 1, "total": n.over(Window.partitionBy("doc")) + start - 1})
    return pages.withColumn("label", F.when(chosen, label))


def bates_number(pages: DataFrame, order: str = "doc", prefix: str = "", digits: int = 6, start: int = 1, suffix: str = "") -> DataFrame:
    """``bates``: one sequence over all documents in order."""
    return merge_docs(pages, order).withColumn("bates", bates_label(F.col("merged") + start, prefix, suffix, digits)).drop("merged")


#: A name that ends in a number as given to a repeated name, before its extension: what is before it, the number, the extension.
NUMBERED = r"(?s)^(.*) \(([1-9]\d*)\)((?:\.[^.]*)?)\z"


def _settled(claims: DataFrame, files: DataFrame) -> DataFrame:
    """``claims`` (``_base, _n, _came, _name``) with ``_own``, whether a name came before a repeated ``_base`` took its number, and ``_from``.

    ``files``: ``_base, _j, _at``, the repeated names of each base, numbered from 1, and their places in the order. The j-th takes number j + 1 and one
    more for each number up to there that was gone when its turn came: those of claims whose own name came first. How many
    these are before a claim lies between the sure ones and all possible ones; the more, the earlier the file that would take the claim's number. So
    a claim that is sure either way for both ends is sure, the first unsure one of a base always is, and the rest wait for another round.
    """
    at = lambda c: files.select(F.col("_base").alias("_b"), F.col("_j").alias("_k"), F.col("_at").alias(c))
    on = lambda j: (F.col("_base") == F.col("_b")) & (F.col(j) == F.col("_k"))
    state = cut(claims.withColumn("_own", F.lit(None).cast("boolean")))
    while True:
        sure = F.when(F.col("_own"), 1).otherwise(0)
        may = F.when(F.coalesce("_own", F.lit(True)), 1).otherwise(0)
        step = state.withColumns({"_sure": sure, "_may": may})
        step = prefix_sums(prefix_sums(step, "_n", "_may", "_most", ["_base"]), "_n", "_sure", "_least", ["_base"])
        step = step.withColumns({"_early": F.col("_n") - 1 - F.col("_most"), "_late": F.col("_n") - 1 - F.col("_least")})
        step = step.join(at("_e"), on("_early"), "left").drop("_b", "_k").join(at("_l"), on("_late"), "left").drop("_b", "_k")
        own = F.when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_e").isNull() | (F.col("_came") < F.col("_e")), True).when(F.col("_came") > F.col("_l"), False)
        state = cut(step.select("_base", "_n", "_came", "_name", own.alias("_own"), F.col("_early").alias("_from")))
        if not state.filter("_own is null").limit(1).count():
            break
    counted = prefix_sums(state.withColumn("_sure", F.when(F.col("_own"), 1).otherwise(0)), "_n", "_sure", "_gone", ["_base"])
    return cut(counted.select("_base", "_name", "_own", (F.col("_n") - 1 - F.col("_gone")).alias("_from")))


def unique_names(files: DataFrame, name: str = "name", order: str = "tab_order") -> DataFrame:
    """``unique``: in order, a name that an earlier file has, whatever the case, gets " (2)" before its extension, or the next number that is free.

    Files of one name are counted by ranges of the order, so one name may be that of most files, and get their numbers from that
    count. Only a file whose own name is such a number of another name can be in the way: which of both comes first is settled in rounds, from
    names without numbers to those that have several, by joins; no task goes through a family of names.
    """
    df = cut(prefix_sums(files.withColumns({"_low": F.lower(F.col(name)), "_one": F.lit(1)}), order, "_one", "_k", ["_low"]).drop("_one"))
    groups = df.groupBy("_low").agg(F.min(order).alias("_came"))
    part = lambda k: F.regexp_extract("_low", NUMBERED, k)
    numbered = groups.filter(F.col("_low").rlike(NUMBERED)).select(F.col("_low").alias("_name"), "_came", F.concat(part(1), part(3)).alias("_base"), part(2).try_cast("long").alias("_n"))
    claims = cut(numbered.filter("_n >= 2").join(groups.select(F.col("_low").alias("_base")), "_base", "left_semi"))
    settled = None
    while claims.limit(1).count():
        waiting = claims.select(F.col("_name").alias("_base"))
        ready, claims = cut(claims.join(waiting, "_base", "left_anti")), cut(claims.join(waiting, "_base", "left_semi"))
        owned = df.select("_low", "_k", F.col(order).alias("_at")).join(ready.select(F.col("_base").alias("_low")).distinct(), "_low", "left_semi")
        if settled is None:
            owned = owned.withColumn("_j", F.col("_k"))
        else:
            known = settled.select(F.col("_name").alias("_low"), "_own")
            owned = owned.join(known, "_low", "left").withColumn("_j", F.col("_k") + F.when(F.coalesce("_own", F.lit(True)), 0).otherwise(1))
        found = _settled(ready, cut(owned.filter("_j >= 1").select(F.col("_low").alias("_base"), "_j", "_at")))
        settled = found if settled is None else cut(settled.union(found))
    df = df.withColumns({"_j": F.col("_k"), "_more": F.lit(0).cast("long")})
    if settled is not None:
        known = settled.select(F.col("_name").alias("_low"), "_own")
        df = df.join(known, "_low", "left").withColumn("_j", F.col("_k") + F.when(F.coalesce("_own", F.lit(True)), 0).otherwise(1)).drop("_own", "_more")
        # numbers that were gone: each moves the files from the one on that would have taken it
        moved = settled.filter("_own").select(F.col("_base").alias("_low"), (F.col("_from") * 2).alias("_o"), F.lit(1).alias("_v"), F.lit(None).cast("long").alias("_j"))
        asking = df.join(moved.select("_low").distinct(), "_low", "left_semi").select("_low", (F.col("_j") * 2 + 1).alias("_o"), F.lit(0).alias("_v"), "_j")
        sums = prefix_sums(cut(moved.union(asking)), "_o", "_v", "_more", ["_low"]).filter("_j is not null").select(F.col("_low").alias("_b"), F.col("_j").alias("_i"), "_more")
        df = df.join(sums, (F.col("_low") == F.col("_b")) & (F.col("_j") == F.col("_i")), "left").drop("_b", "_i").withColumn("_more", F.coalesce("_more", F.lit(0)))
    tail = F.regexp_extract(F.col(name), r"(\.[^.]*)?\z", 0)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(tail))
    shown = F.concat(stem, F.lit(" ("), (F.col("_j") + 1 + F.col("_more")).cast("string"), F.lit(")"), tail)
    return df.select(*files.columns, F.when(F.col("_j") == 0, F.col(name)).otherwise(shown).alias("unique"))
