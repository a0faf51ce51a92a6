"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space, and tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words kept by a task with their hashes; others are hashed each time.
CACHED_WORDS = 150_000
#: Rows of texts that are handed to Python at once, at most, where the session has Spark's own bound.
BATCH_ROWS = 1000
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: A long text is split into words in pieces of about so many bytes.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one is set only where there is none."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later steps neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: What a worker's tasks keep while they run.
CACHES: list[dict] = []


def give_back() -> None:
    """Empties the caches and hands freed memory to the system: Spark keeps its workers, which else stay as large as their largest task."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_python(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in small batches, as texts can be long; at its end a task gives its memory back."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == _BATCH_DEFAULT:
        conf.set(_BATCH, str(BATCH_ROWS))

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(frugal, schema)


#: Rows of a written table that one task reads on, at least, in ``compact``.
COMPACT_ROWS = 100_000


def counted(df: DataFrame) -> int:
    """The rows of a written table, by a task for each core: the driver keeps a record of every task, of empty ones too."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)).count()


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than so many rows need."""
    return df.coalesce(1 + rows // COMPACT_ROWS)


def compact(df: DataFrame, most: int | None = None) -> DataFrame:
    """``cut``, read on by no more tasks than its rows need: small tables of many rounds else leave very many small shuffle files.

    Where it is known that there are about ``most`` rows or fewer, it is written by no more tasks either, and not counted.
    """
    if most is not None:
        return cut(narrow(df, most))
    df = cut(df)
    return narrow(df, counted(df))


def carried(df: DataFrame, most: int | None = None) -> DataFrame:
    """``compact`` for the tables that a round hands to the next: without the size that Spark estimated for the plan that made them.

    A written table keeps that estimate, and a join's estimate is the product of its sides'. Handed on, it has several times as many digits after
    every round, until numbers of megabytes fill the driver's memory.
    """
    df, session = cut(df if most is None else narrow(df, most)), df.sparkSession
    rows = DataFrame(session._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), session)
    return narrow(rows, counted(df) if most is None else most)


#: A table of at most so many rows of a few numbers is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have no more than ``rows`` rows."""
    some = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)).limit(rows + 1)
    return F.broadcast(df) if some.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's decimal text modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def words_column(text: Column, lower: bool = True) -> Column:
    """The words of a text as an array, without empty ones; null text has none."""
    text = F.coalesce(text, F.lit(""))
    text = F.translate(text, UPPER, LOWER) if lower else text
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hash by word. It keeps no more than ``CACHED_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


_HASHES = WordHashes()
CACHES.append(_HASHES)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def pieces(data: bytes, most: int = PIECE_BYTES):
    """``data`` in pieces of about ``most`` bytes that end where a word ends."""
    at = 0
    while len(data) - at > most:
        end = at + most
        stop = len(data)
        for sep in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"):
            found = data.find(sep, end, stop)
            stop = found if found >= 0 else stop
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """The hashes of the words of a whole text, in order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        data = data.translate(_LOWER)
    out = []
    for piece in pieces(data):
        words = piece.split()
        out.append(np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of ``n`` words in a row; of all words where they are fewer; of none, none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        h = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = (h ^ hashes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(mix(h, n))
