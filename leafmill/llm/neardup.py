"""MinHash near-duplicates (operator 8) by fast similarity sketching.

A sketch has ``COORDINATES`` bins. In round i every shingle is hashed to a bin and a value; an empty bin takes the least
value of the first round that reaches it. The first half of the rounds choose bins at random, and round COORDINATES + j
sends all shingles to bin j, so that every bin fills. Bins in which two sketches agree estimate their Jaccard
similarity. Sketches are cut into bands; documents that agree in a band are candidates, and candidates are
confirmed on their full shingle sets.

Rows with equal sets form a class, of which only the smallest id goes on. In a band's bucket first all members are
compared with one, and components are formed. In buckets that still hold several components, members are compared with the most
central one, and with those that share a shingle with them which few others hold; a pair that shares none can be linked
only by shingles that many hold. Members that have too few of those for any partner's size are done with. The others go
on with four times as large a bound of what is few, and where few members are outside a bucket's largest component these are
compared with all others that have enough. A round makes at most a bounded multiple of its shingles and members in pairs, no link between components is left out, and a bucket of copies costs about as many pairs as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import carried, compact, counted, cut, fresh, in_python, mix, narrow, shingles, small, word_hashes

#: At similarity 0.8 a pair shares none of the bands with a chance of 1.3e-7, at 0.85 of 7e-11.
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
#: A shingle that no more sets than this hold is rare; four times as many in each later round.
RARE = 32
#: A quarter of the members outside a bucket's largest component that its second round compares with all others; four times as many in each later one.
HUBS = 16
#: A table of so many rare shingles is broadcast.
RARE_BROADCAST = 200_000
#: Rows whose shingles a task holds at a time.
CHUNK_ROWS = 1000
_SEEDS = mix(np.arange(2 * COORDINATES, dtype=np.uint64), 11)


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: by bin the round (9 bits) and the value (47 bits)."""
    out, empty, first = np.zeros(t, np.uint64), np.ones(t, bool), 0
    bins = np.arange(t, dtype=np.uint64)
    while empty.any():
        rounds = np.arange(first, min(2 * t, first + max(1, 2 * t // len(elements))), dtype=np.uint64)
        h = mix(elements[None, :] ^ _SEEDS[rounds.astype(np.int64)][:, None])
        own = np.maximum(rounds, np.uint64(t))[:, None] - np.uint64(t)
        at = np.where(rounds[:, None] < t, (h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24), own)
        key = np.sort((at << np.uint64(56) | rounds[:, None] << np.uint64(47) | h & np.uint64((1 << 47) - 1)).ravel())
        begin = np.searchsorted(key, bins << np.uint64(56))
        found = key[np.minimum(begin, len(key) - 1)]
        new = empty & (begin < len(key)) & (found >> np.uint64(56) == bins)
        out[new] = found[new] & np.uint64((1 << 56) - 1)
        empty &= ~new
        first = int(rounds[-1]) + 1
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    h = _SEEDS[:BANDS].copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix(h ^ coordinates.reshape(BANDS, ROWS)[:, k], k + 1)
    return h.view(np.int64)


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, th, n, key, bands`` of each row of ``doc_id, text``: the text's hash, its set's size, 128-bit hash and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, own = [], [], []
            for text in batch.column(1):
                s = shingles(word_hashes(text.as_py()), shingle)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                own.append(bands(sketch(s)) if len(s) else None)
            arrays = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "n", "key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return in_python(rows, run, "doc_id long, th long, n long, key binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int = 5) -> DataFrame:
    """Those pairs ``a, b`` whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.as_py(), b.as_py()
                if last[0] != a:
                    last = (a, shingles(word_hashes(a), shingle))
                x, y = last[1], shingles(word_hashes(b), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns[:2], names=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return in_python(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb"), run, "a long, b long")


def held_shingles(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """``id, h``: 32 bits of each distinct shingle of the texts ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, CHUNK_ROWS) for b in batches for k in range(0, b.num_rows, CHUNK_ROWS)):
            sets = [np.unique((shingles(word_hashes(t.as_py()), shingle) >> np.uint64(32)).astype(np.uint32)) for t in batch.column(1)]
            h = np.concatenate([np.empty(0, np.uint32), *sets]).view(np.int32)
            who = np.repeat(np.arange(batch.num_rows), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(h)], names=["id", "h"])

    return in_python(texts.select("id", "text"), run, "id long, h int")


def split_by_rarity(held: DataFrame, sizes: DataFrame, several_texts: DataFrame, percent: int, rare: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``id, n, label, common`` of the sets ``id, n, label``, and ``id, h, n, label`` of the rare shingles that decide.

    A shingle of ``held`` (``id, h``) that 2 to ``rare`` sets hold is rare, one that more hold is common. Two sets that can
    be linked share one of the rows returned, or have no more in common than the lesser of their two ``common``: of a set's rare
    shingles, the rarest first, only so many are returned that the rest is too small for a link. Shingles are known by 32
    bits: those of one hash count as one, and what a set loses by that counts as common. For the ids of ``several_texts``, whose
    rows of ``held`` come from different texts, all is common and all rare shingles are returned. ``most``: no more sets than this.
    """
    seen = cut(held.groupBy("h").agg(F.count("*").alias("f"), F.min("id").alias("id")).filter(F.col("f") <= rare))
    alone = seen.filter("f = 1").groupBy("id").agg(F.count("*").alias("alone"))
    few = cut(held.join(small(seen.filter("f > 1").select("h", "f"), RARE_BROADCAST), "h"))
    several = few.groupBy("id").agg(F.count("*").alias("several"))
    many = several_texts.withColumn("many", F.lit(True))
    own = sizes.join(alone, "id", "left").join(several, "id", "left").join(small(many), "id", "left").na.fill(0, ["alone", "several"])
    reach = F.when(F.col("many"), F.col("n") + F.col("several")).otherwise(F.col("n") - F.col("alone"))
    common = F.when(F.col("many"), F.col("n")).otherwise(F.col("n") - F.col("alone") - F.col("several"))
    own = compact(own.select("id", "n", "label", reach.alias("reach"), common.alias("common")), most)
    rank = F.row_number().over(Window.partitionBy("id", "n").orderBy("f", "h"))
    least = F.ceil(F.lit(percent) * F.col("n") / F.lit(100))
    rows = few.join(own.filter(F.col("reach") >= least), "id").withColumn("rank", rank)
    return own.select("id", "n", "label", "common"), rows.filter(F.col("rank") <= F.col("reach") - least + 1).select("id", "h", "n", "label")


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` of every vertex of the edges ``a, b``: the smallest vertex that it can reach.

    Each round takes the least label of the neighbours and then that label's own label, until none changes. Its joins are
    merges throughout: one turned into a broadcast when its sides are dealt already takes a task for each of their parts.
    """
    both = carried(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    labels = carried(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), n)
    while True:
        near = narrow(both.join(labels.hint("merge"), F.col("b") == F.col("v")).select("a", "label"), n).groupBy("a").agg(F.min("label").alias("m"))
        step = narrow(labels.join(near.hint("merge"), F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "m").alias("l")), n)
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("up"))
        after = carried(step.join(up.hint("merge"), F.col("l") == F.col("u")).select("v", "old", F.least("l", "up").alias("label")), n)
        labels = after.select("v", "label")
        if not after.filter("old <> label").limit(1).count():
            return labels


def mixed_buckets(members: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The rows ``h, rep, ...`` of buckets ``h`` that hold several components, with the ``label`` of each; there are at most ``most`` members."""
    m = members.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    m = narrow(m, most)
    mixed = m.groupBy("h").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select("h")
    return m.join(mixed, "h", "left_semi")


def linked(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``doc_id, th, n_shingles, key, component_id, kept`` for each row of ``doc_id, text``, as ``near_duplicates`` has them; ``th`` and ``key`` as ``sketches``."""
    s = cut(sketches(docs, shingle))
    used = s.filter("n > 0 and doc_id is not null")
    classes = cut(used.groupBy("key").agg(F.min(F.struct("doc_id", "th", "n", "bands")).alias("x")).select("key", F.col("x.doc_id").alias("rep"), "x.th", "x.n", "x.bands"))
    cells = classes.select("rep", "n", F.explode("bands").alias("h"))
    shared = cells.groupBy("h").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    members = compact(cells.join(shared.select("h", "hub"), "h"))
    n_members = members.count()

    ids = compact(members.select(F.col("rep").alias("id")).distinct(), n_members)
    wanted = classes.select(F.col("rep").alias("id"), F.col("th").alias("_th")).join(ids, "id", "left_semi")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.xxhash64("text").alias("_t"))
    rows = rows.join(small(cut(wanted)), (F.col("_id") == F.col("id")) & (F.col("_t") == F.col("_th")))
    texts = cut(rows.groupBy("id", "_t").agg(F.first("text").alias("text")).select("id", F.col("_t").alias("th"), "text"))

    alike = F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.filter(alike & (F.col("rep") != F.col("rep2"))).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()

    first = compact(ordered(members.select("rep", "n", F.col("hub.rep").alias("rep2"), F.col("hub.n").alias("n2"))), n_members)
    # rows of one id with different texts belong together
    several = used.groupBy("doc_id").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).filter("k1 <> k2").select("doc_id")
    same = used.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(classes.select("key", "rep"), "key")
    edges = carried(confirmed(first, texts, percent, shingle).union(same.filter("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))))
    labels = components(edges)
    open_ = carried(mixed_buckets(members.select("h", "rep", "n"), labels, n_members), n_members)
    held = cut(held_shingles(texts.join(small(cut(open_.select(F.col("rep").alias("id")).distinct())), "id", "left_semi"), shingle))
    several_texts = compact(texts.groupBy("id").count().filter("count > 1").select("id"))
    tested, rare, most = first, RARE, counted(texts)
    while n_open := open_.count():
        sizes = compact(open_.select(F.col("rep").alias("id"), "n", "label").distinct(), n_open)
        own, rows = split_by_rarity(held.join(small(sizes.select("id").distinct()), "id", "left_semi"), sizes, several_texts, percent, rare, n_open)
        other = rows.select("h", F.col("id").alias("rep2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
        by_rare = ordered(rows.withColumnRenamed("id", "rep").join(other, "h").filter((F.col("rep") < F.col("rep2")) & (F.col("label") != F.col("label2"))))
        m = compact(open_.join(own.select(F.col("id").alias("rep"), "n", "common"), ["rep", "n"]), n_open)
        m = compact(m.join(m.groupBy("rep", "n").agg(F.array_sort(F.collect_set("h")).alias("hs")), ["rep", "n"]), n_open)
        size = m.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size"))
        size = size.select("h", F.col("top.label").alias("major"), (F.col("size") - F.col("top.c")).alias("rest"))
        # first the member with the fewest shingles of its own, which copies of one text have in common; later members outside the largest component
        others = m if rare == RARE else m.join(size.select("h", "major"), "h").filter(F.col("label") != F.col("major"))
        hubs = 1 if rare == RARE else HUBS * rare // RARE
        place = F.row_number().over(Window.partitionBy("h").orderBy(F.desc(F.col("common") / F.col("n")), "rep"))
        hub = others.withColumn("place", place).filter(F.col("place") <= hubs)
        hub = hub.select("h", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "common", "label", "hs")])
        bound = F.least("common", "common2")
        can = F.lit(100 + percent) * bound >= F.lit(percent) * (F.col("n") + F.col("n2"))
        # a pair is met in the first bucket that it shares only
        once = F.get(F.array_intersect("hs", "hs2"), F.lit(0)) == F.col("h")
        by_hub = ordered(m.join(hub, "h").filter((F.col("label") != F.col("label2")) & can & alike & (once if rare > RARE else F.lit(True))))
        pairs = compact(by_rare.union(by_hub).distinct().join(tested, ["a", "b"], "left_anti"))
        found = carried(confirmed(pairs, texts, percent, shingle))
        if found.limit(1).count():
            edges = edges.union(found)
            labels = components(edges)
        if rare >= most:
            break
        # what is left are links by common shingles alone: the largest size of a partner must be met in the bucket
        fit = F.floor(F.lit(100 + percent) * F.col("common") / F.lit(percent)).cast("long") - F.col("n")
        if rare > RARE:
            # where all members outside the largest component were compared with all others, no link is missing
            m = m.join(size.filter(F.col("rest") > hubs).select("h"), "h", "left_semi")
        m = compact(mixed_buckets(m.select("h", "rep", "n", "common"), labels, n_open).withColumn("fit", fit), n_open)
        partner = m.groupBy(F.col("h").alias("h2"), F.col("n").alias("n2")).agg(F.max("fit").alias("fit2"), F.min("label").alias("l1"), F.max("label").alias("l2"))
        fits = (F.col("n2") <= F.col("fit")) & (F.col("n") <= F.col("fit2")) & ((F.col("l1") != F.col("label")) | (F.col("l2") != F.col("label")))
        m = m.join(partner, (F.col("h") == F.col("h2")) & fits, "left_semi")
        open_ = carried(mixed_buckets(m.select("h", "rep", "n"), labels, n_open), n_open)
        tested, rare = tested.union(pairs), rare * 4

    name = classes.join(labels, F.col("rep") == F.col("v"), "left").select(F.col("key").alias("_key"), F.coalesce("label", "rep").alias("component"))
    out = s.select("doc_id", "th", "n", "key").join(name, F.col("key") == F.col("_key"), "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "key", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``doc_id, text``.

    Words are runs without white space in lower case (A-Z only); a set holds the distinct runs of ``shingle`` words, or the
    whole sequence where there are fewer. Rows are linked if 100 * intersection >= percent * union. Null, empty and
    blank texts have no shingles and no link; rows without an id are not linked and are kept. Rows of one id are one
    document: linked when any of them is; repeated rows have equal results. An empty table gives an empty result; other
    columns are dropped.
    """
    return linked(docs, percent, shingle).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest id of each group; of its rows with equal sets, one.

    Rows without an id, or without words, all stay.
    """
    found = cut(linked(docs.select("doc_id", "text"), percent, shingle))
    key, text, words = fresh(docs, "_other"), fresh(docs, "_text_hash"), fresh(docs, "_set_key")
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(text))
    other = cut(found.filter(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("th").alias(text)).distinct())
    kept = docs.join(small(other), same, "left_anti")
    rows = found.filter("kept and doc_id is not null and n_shingles > 0")
    sets = rows.groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    again = cut(rows.join(sets, ["doc_id", "key"], "left_semi").select(F.col("doc_id").alias(key), F.col("th").alias(text), F.col("key").alias(words)).distinct())
    if not again.limit(1).count():
        return kept
    again = small(again)
    once = kept.join(again, same).dropDuplicates(["doc_id", words]).select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(once)
