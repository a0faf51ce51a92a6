"""Benchmark decontamination (operator 6): size-partitioned MinHash containment search, in DataFrame functions only.

An item's signature has ``COORDINATES`` hash functions; coordinate i holds the item's shingle of least i-th hash. The share
of an item's coordinates whose shingle is in a document estimates the item's containment in it, however long the
document is. Documents are partitioned by their number of shingles: short ones are searched with the first few
coordinates, longer ones, which meet more shingles by chance, with more. A document and an item are candidates if at most as
many coordinates' shingles are missing as the threshold allows of the whole item; candidates are confirmed by exact
containment of shingles, compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, fresh, small, words_column

COORDINATES = 32
#: Coordinates for documents of under 64 shingles, and as many more for each fourfold size.
FIRST, MORE = 12, 4


def _shingles(words: Column, n: Column, width: int) -> Column:
    """The runs of ``width`` words as structs; none where there are fewer words."""
    runs = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(n - width + 1, F.lit(0))).alias(f"w{k}") for k in range(width)])
    return F.explode(runs)


def keyed_items(items: DataFrame) -> DataFrame:
    """``key, item_id, text`` of the distinct rows: each text of an id, or of none, is an item of its own."""
    key = F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("item_id").isNull(), F.coalesce("text", F.lit("")))
    return items.select("item_id", "text").distinct().select(key.alias("key"), "item_id", "text")


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """``key, width, x`` by distinct shingle; items of fewer words are one shingle of that width. Null and blank items have none."""
    words = items.select("key", words_column(F.col("text")).alias("w")).filter("size(w) > 0")
    words = words.withColumn("width", F.least(F.size("w"), F.lit(shingle)))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda k: F.concat_ws(" ", F.slice("w", k, F.col("width"))))
    return words.select("key", "width", F.explode(F.array_distinct(runs)).alias("x"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``doc_id, th, item_id, item_shingles, shared, containment`` of documents that hold at least ``threshold`` of an item.

    ``docs`` has doc_id and text, ``items`` item_id and text; ``th`` is a hash of the text, so that rows of one id, or of none,
    keep apart. Words are runs without white space, A-Z in lower case. Rows and items of equal id and text count once; different
    texts of one item_id, or of none, are items of their own, each with a row for every text that holds it. Null, empty and blank
    texts and items take no part, an item of fewer words than ``shingle`` is one shingle; tables without rows give no rows.
    """
    allowed = F.lit(1 - threshold + 1e-9)
    named = cut(keyed_items(items))
    texts = cut(item_shingles(named, shingle))
    sizes = texts.groupBy("key").agg(F.count("*").alias("q"))
    widths = [r[0] for r in texts.select("width").distinct().collect()]  # at most one for each width up to ``shingle``
    hashed = texts.select("key", "width", F.col("x"), F.explode(F.sequence(F.lit(0), F.lit(COORDINATES - 1))).alias("i"))
    least = hashed.groupBy("key", "width", "i").agg(F.min_by("x", F.struct(F.xxhash64("x", "i"), "x")).alias("x"))
    signature = least.groupBy("key", "width", "x").agg(F.min("i").alias("i")).join(sizes, "key")
    signature = cut(signature.select("key", "width", F.xxhash64(F.col("x")).alias("s"), "i", "q"))
    # of an item's coordinates, those that a size partition uses
    level = F.explode(F.sequence(F.lit(FIRST), F.lit(COORDINATES), F.lit(MORE))).alias("used")
    probes = signature.select("key", "q", "i", level).filter("i < used").groupBy("key", "used").agg(F.count("*").alias("probes"), F.first("q").alias("q"))
    probes = probes.select("key", "used", F.greatest(F.lit(1), F.col("probes") - F.floor(F.col("q") * allowed)).alias("need"))

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    words = rows.select("doc_id", "th", words_column(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    fourfold = F.floor(F.log(F.greatest(F.col("n"), F.lit(64)) / 64.0) / F.log(F.lit(4.0))).cast("int")
    words = words.withColumn("used", F.least(F.lit(COORDINATES), FIRST + MORE * fourfold))
    wanted = small(signature)
    hits = None
    for width in widths:
        x = words.select("doc_id", "th", "n", "used", _shingles(F.col("w"), F.col("n"), width).alias("r"))
        x = x.select("doc_id", "th", "n", "used", F.xxhash64(F.concat_ws(" ", *[f"r.w{k}" for k in range(width)])).alias("s"))
        x = x.join(wanted.filter(F.col("width") == width), "s").filter((F.col("i") < F.col("used")) & (F.col("n") - width + 1 >= F.col("q") * F.lit(threshold - 1e-9)))
        x = x.select("doc_id", "th", "used", "key", "s")
        hits = x if hits is None else hits.union(x)
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", th long, item_id " + items.schema["item_id"].dataType.simpleString() + ", item_shingles long, shared long, containment double"
    if hits is None:
        return docs.sparkSession.createDataFrame([], schema)
    found = hits.distinct().groupBy("doc_id", "th", "used", "key").count()
    candidates = cut(found.join(probes, ["key", "used"]).filter("count >= need").select("doc_id", "th", "key"))

    pair = candidates.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "key")
    whole = texts.select("key", "width", F.col("x").alias("y"))
    keys = candidates.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    own = words.join(small(keys), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi")
    exact = None
    for width in widths:
        x = own.select("doc_id", "th", _shingles(F.col("w"), F.col("n"), width).alias("r"))
        x = x.select("doc_id", "th", F.concat_ws(" ", *[f"r.w{k}" for k in range(width)]).alias("x"))
        x = x.join(small(whole.filter(F.col("width") == width)), F.col("x") == F.col("y")).select("doc_id", "th", "key", "x")
        exact = x if exact is None else exact.union(x)
    shared = exact.join(pair.withColumnRenamed("key", "_k"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("key") == F.col("_k")), "left_semi")
    shared = shared.distinct().groupBy("doc_id", "th", "key").agg(F.count("*").alias("shared"))
    out = shared.join(sizes, "key").filter(F.col("shared") >= F.col("q") * F.lit(threshold - 1e-9)).join(named.select("key", "item_id"), "key")
    return out.select("doc_id", "th", "item_id", F.col("q").alias("item_shingles"), "shared", (F.col("shared") / F.col("q")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows of null or empty text stay."""
    found = contaminated(docs.select("doc_id", "text"), items, threshold, shingle)
    key, text = fresh(docs, "_bad_id"), fresh(docs, "_bad_text")
    bad = cut(found.select(F.col("doc_id").alias(key), F.col("th").alias(text)).distinct())
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text)), "left_anti")
