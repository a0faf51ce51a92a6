"""Files against lists of known hashes and of operations that accept them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.files import clean_hash, hash_all
from leafmill.operators.tables import cut

# The hashes in the order in which they count.
ALGORITHMS = ["sha256", "sha512", "sha1", "md5"]


def with_hashes(files: DataFrame, content: Column) -> DataFrame:
    return files.withColumns(hash_all(content))


#: A list of known hashes is broadcast if it is no longer than ``SHORT``, and gets bitmaps up to ``MOST_KNOWN``: of Spark's own size, about 16 bits a hash.
SHORT, BITMAP_BITS, MOST_KNOWN = 200_000, 1 << 15, 4_000_000


def _may_be_known(lists: DataFrame, n: int):
    """A test of a hash against bitmaps of ``lists`` (``hash``, ``n`` rows): false only for hashes that are not there."""
    bitmaps = max(1, -(-16 * n // BITMAP_BITS))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bitmaps * BITMAP_BITS)) + 1
    made = lists.groupBy((F.bitmap_bucket_number(place("hash")) - 1).alias("_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("hash"))).alias("_map"))
    every = lists.sparkSession.range(bitmaps).join(made, F.col("id") == F.col("_no"), "left")
    held = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_map"))), lambda x: x["_map"])).scalar()  # at most 8 MB

    def test(column: str):
        at = F.bitmap_bit_position(place(column))
        byte = F.conv(F.hex(F.substring(F.get(held, (F.bitmap_bucket_number(place(column)) - 1).cast("int")), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1, F.lit(False))

    return test


def match_hashes(hashed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``key, hash, algorithm`` of files that have a hash of ``known`` (column ``hash``, as pasted); the first algorithm counts.

    A short list goes to every task, so nothing is shuffled but what is found. For a longer one a bitmap of the known hashes drops
    nearly all other files before each file's four hashes become rows of their own; one too long for that is joined without it.
    """
    lists = cut(known.select(clean_hash(F.col("hash")).alias("hash")).filter("hash is not null").distinct())
    n = lists.limit(MOST_KNOWN + 1).count()
    if n <= SHORT:
        lists = F.broadcast(lists)
    elif n <= MOST_KNOWN:
        may = _may_be_known(lists, n)
        hashed = hashed.filter(may(ALGORITHMS[0]) | may(ALGORITHMS[1]) | may(ALGORITHMS[2]) | may(ALGORITHMS[3]))
    pairs = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(a).alias("algorithm"), F.col(a).alias("hash")) for k, a in enumerate(ALGORITHMS)])
    rows = hashed.select(key, F.explode(pairs).alias("h")).select(key, "h.rank", "h.algorithm", "h.hash")
    return rows.join(lists, "hash").groupBy(key).agg(F.min_by("algorithm", "rank").alias("algorithm"), F.min_by("hash", "rank").alias("hash"))


def tools_for(files: DataFrame, tools: DataFrame) -> DataFrame:
    """Which operation (``id, accepts``) takes which file (``kind``); one that accepts ``unknown`` takes any.

    A file asks for its own kind and for ``unknown``, and an operation answers to one of both, so the join is by equality and meets no pair twice.
    """
    kinds = F.when(F.array_contains("accepts", "unknown"), F.array(F.lit("unknown"))).otherwise(F.array_distinct("accepts"))
    wanted = tools.select("id", F.explode(kinds).alias("_kind")).distinct()
    asking = files.withColumn("_kind", F.explode(F.array_distinct(F.array_compact(F.array(F.col("kind"), F.lit("unknown"))))))
    return asking.join(wanted, "_kind").drop("_kind")


def size_savings(sizes: DataFrame) -> DataFrame:
    """``saved`` of ``before, after``: the share saved; the original is kept unless a tenth is saved. Of an empty file nothing is."""
    smaller = F.col("after") <= F.col("before") * 0.9
    return sizes.withColumn("kept", F.when(smaller, F.col("after")).otherwise(F.col("before"))).withColumn("saved", F.coalesce(1 - F.try_divide("kept", "before"), F.lit(0.0)))
