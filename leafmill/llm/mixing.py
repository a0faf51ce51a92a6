"""Mixing sources to target weights (operator 7).

Efraimidis-Spirakis sampling: a document of weight w has the key -ln(u) / w, u uniform from a hash of its id; within a
source documents are taken by rising key until the running sum of sizes reaches the source's budget. A budget above
the source's size takes whole epochs first, and only the rest is selected by key.

A source may hold most rows, so the running sum is made in two steps: sums of key ranges, then exact sums inside the
one range in which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import fresh, word_count

#: A source's keys fall in so many ranges; only one of them is ever sorted by row.
RANGES = 4096


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of the key's text; null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_epochs: float = 3, budget: Column | None = None) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes (or ``budget``). No target
    exceeds ``most_epochs`` times its source's size; the excess goes to the others by weight. Sources are few: the one
    window over all of them holds a row for each. Sources of size 0 have target 0; of no sources, none.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most_epochs))
    df = sizes.withColumn("_w", weight).withColumn("_cap", cap)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    df = (
        df.withColumn("_total", (F.sum("source_size").over(every) if budget is None else budget).cast("double"))
        .withColumn("_before", F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_weights", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        # what a unit of weight would get, were all sources of a smaller ratio at their caps and the rest not
        .withColumn("_level", (F.col("_total") - F.coalesce("_before", F.lit(0.0))) / F.col("_weights"))
        .withColumn("_capped", F.col("_cap") <= F.col("_w") * F.col("_level"))
        .withColumn("_first", F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull().alias("n"), F.col("source"), F.col("_level").alias("level")))).over(every)["level"])
    )
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_first")))
    return df.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_epochs: float = 3) -> DataFrame:
    """``doc_id, source, size, weight`` to ``doc_id, source, size, source_size, target, copies, taken``, a row for each row.

    ``copies``: how often the mix takes the document; ``taken``: its words times that. The document in which the budget ends
    is taken if that brings the sum nearer. Null or non-positive weights: never before others, key infinite. Null size
    counts as 0. Ties of keys go to the smaller doc_id; repeated rows of one id and size are taken together when
    they tie inside the last range. An empty table gives an empty result. Other columns are dropped.
    """
    key = F.when(F.col("weight") > 0, -F.log(uniform(F.col("doc_id"))) / F.col("weight")).otherwise(F.lit(float("inf")))
    rows = docs.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), key.alias("_key"))
    # rising with the key, so that ranges are in the order of keys
    rows = rows.withColumn("_range", F.floor(F.lit(RANGES) * (1 - F.exp(-F.col("_key")))).cast("int"))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most_epochs)
    up_to = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    ranges = (
        ranges.withColumn("_before", F.coalesce(F.sum("_size").over(up_to), F.lit(0)))
        .join(t, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .withColumn("_ends", (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_size") >= F.col("_rest")))
        .select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before", "_size", "source_size", "target", "_epochs", "_rest", "_ends")
    )
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    whole = rows.filter(~F.col("_ends")).withColumn("_more", F.col("_before") + F.col("_size") <= F.col("_rest"))
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("_ends").withColumn("_sum", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = last.withColumn("_more", F.col("_sum") + F.col("size") / 2 <= F.col("_rest")).drop("_sum")
    out = whole.unionByName(last)
    copies = (F.col("_epochs") + F.when(F.col("_more"), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``weight``: 2 where a label calls its quality good, 0.5 where not good, 1 where none is known."""
    key, good = fresh(docs, "_id"), fresh(docs, "_q")
    known = labels.groupBy(F.col("doc_id").alias(key)).agg(F.max("quality").alias(good))
    weight = F.when(F.col(good) >= 1, 2.0).when(F.col(good) < 1, 0.5).otherwise(1.0)
    return docs.join(known, F.col("doc_id") == F.col(key), "left").withColumn("weight", weight).drop(key, good)


def mixed(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_epochs: float = 3) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows are known by a hash of id, source and text; rows equal in these are taken equally often.
    """
    row = F.xxhash64("doc_id", "source", "text")
    sizes = quality_weight(docs.select("doc_id", "source", row.alias("row"), word_count(F.col("text")).alias("size")), labels)
    plan = mix_sources(sizes.select(F.col("row").alias("doc_id"), "source", "size", "weight"), weights, most_epochs)
    key, n = fresh(docs, "_row"), fresh(docs, "_copies")
    plan = plan.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(n)).filter(F.col(n) > 0)
    taken = docs.join(plan, row == F.col(key)).withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n))))
    return taken.select(*[f"`{c}`" for c in docs.columns])
