"""Image files as tables of their segments ``key, seq, marker, start, length, bytes``: what to keep, and clean bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.metadata import RENDERING_CHUNKS

# The sum of the standard luminance table for quality 50.
STANDARD_SUM = 3688


def keeps(marker: Column, payload: Column, keep_icc: bool = True) -> Column:
    """Whether a segment is needed to show the picture: no comments and application data but JFIF, Adobe and, if asked, ICC."""
    head = F.decode(F.substring(payload, 1, 12), "ISO-8859-1")
    application = marker.rlike("^E[0-9A-F]$") | (marker == "FE")
    kept = ((marker == "E0") & head.startswith("JFIF")) | (marker == "EE") | (F.lit(keep_icc) & (marker == "E2") & head.startswith("ICC_PROFILE"))
    return F.when(F.length(marker) == 2, ~application | kept).otherwise(marker.isin(RENDERING_CHUNKS))


def keep_drop(segments: DataFrame, keep_icc: bool = True) -> DataFrame:
    return segments.withColumn("keep", keeps(F.col("marker"), F.col("bytes"), keep_icc))


def upright_tiff(turn: Column) -> Column:
    """An EXIF block that holds the orientation alone."""
    return F.concat(F.unhex(F.lit("4D4D002A000000080001011200030000000100")), F.unhex(F.lpad(F.hex(turn), 2, "0")), F.unhex(F.lit("000000000000")))


def exif_segment(tiff: Column, png: Column) -> Column:
    """The bytes of a JPEG's segment, or a PNG's chunk, that holds an EXIF block; none where there is none or it is too long for a segment."""
    number = lambda n, digits: F.unhex(F.lpad(F.hex(n), digits, "0"))
    chunk = F.concat(F.lit(b"eXIf"), tiff)
    whole = F.concat(number(F.octet_length(tiff), 8), chunk, number(F.crc32(chunk), 8))
    segment = F.concat(F.unhex(F.lit("FFE1")), number(F.octet_length(tiff) + 8, 4), F.unhex(F.lit("457869660000")), tiff)
    return F.coalesce(F.when(png, whole).when(F.octet_length(tiff) + 8 <= 0xFFFF, segment), F.unhex(F.lit("")))


def sanitize(files: DataFrame, segments: DataFrame, key: str = "path", content: str = "content", keep_icc: bool = True, orientation: DataFrame | None = None, technical: DataFrame | None = None) -> DataFrame:
    """``key, content`` of JPEG and PNG files without what only describes them: header, kept segments, and a JPEG's image data, in order.

    With ``orientation`` (``key, turn``, 1 to 8) a picture that is not upright keeps that tag alone, after a JPEG's header or a PNG's first chunk;
    with ``technical`` (``key, tiff``, as ``technical_exif`` gives) it keeps that block there instead.
    """
    s = keep_drop(segments, keep_icc).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "length", "keep"))).alias("_s"))
    df = files.select(key, content).join(s, key)
    png = F.substring(F.col(content), 1, 4) == F.unhex(F.lit("89504E47"))
    head = F.substring(F.col(content), F.lit(1), F.when(png, 8).otherwise(2))
    last = F.element_at("_s", -1)
    tail = F.when(png, F.unhex(F.lit(""))).otherwise(F.substring(F.col(content), (last["start"] + last["length"] + 1).cast("int"), F.octet_length(content)))
    kept = F.filter("_s", lambda x: x["keep"])
    own = lambda x: F.substring(F.col(content), (x["start"] + 1).cast("int"), x["length"].cast("int"))
    if orientation is not None or technical is not None:
        block = F.lit(None).cast("binary")
        if orientation is not None:
            df = df.join(orientation.select(F.col(key).alias("_k"), "turn"), F.col(key) == F.col("_k"), "left").drop("_k")
            block = F.when(F.col("turn").between(2, 8), upright_tiff(F.col("turn")))
        if technical is not None:
            df = df.join(technical.select(F.col(key).alias("_k"), F.col("tiff").alias("_tiff")), F.col(key) == F.col("_k"), "left").drop("_k")
            block = F.coalesce("_tiff", block)
        tag = exif_segment(block, png)
        first = F.when(png, own(F.get("_s", F.lit(0)))).otherwise(F.unhex(F.lit("")))
        head, kept = F.concat(head, first, tag), F.when(png, F.filter(F.slice("_s", F.lit(2), F.size("_s")), lambda x: x["keep"])).otherwise(kept)
    body = F.aggregate(kept, head, lambda acc, x: F.concat(acc, own(x)))
    return df.select(key, F.concat(body, tail).alias(content))


def jpeg_quality(segments: DataFrame, key: str = "path") -> DataFrame:
    """``key, quality`` (1 to 100) from a JPEG's luminance table, of 8 or 16 bits, wherever it stands among the tables of a segment."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col("bytes"), i + 1, F.lit(1))), 16, 10).cast("int")
    wide = lambda at: byte(at) >= 16
    # a segment holds four tables at most, each of 65 or 129 bytes
    step = lambda acc, _: F.when((acc >= F.octet_length("bytes")) | (byte(acc) % 16 == 0), acc).otherwise(acc + 1 + F.when(wide(acc), 128).otherwise(64))
    df = segments.filter(F.col("marker") == "DB").withColumn("_at", F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0), step))
    df = df.filter((F.col("_at") < F.octet_length("bytes")) & (byte(F.col("_at")) % 16 == 0))
    df = df.filter(F.octet_length("bytes") > F.col("_at") + F.when(wide(F.col("_at")), 128).otherwise(64))
    at = F.col("_at")
    one = lambda i: F.when(wide(at), byte(at + i * 2 - 1) * 256 + byte(at + i * 2)).otherwise(byte(at + i))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0), lambda acc, i: acc + one(i))
    scale = F.col("_sum") / F.lit(STANDARD_SUM) * 100
    quality = F.when(F.col("_sum") == 64, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), F.floor(F.when(scale <= 100, (200 - scale) / 2).otherwise(5000 / scale) + 0.5))))
    return df.groupBy(key).agg(F.min_by(total, "seq").alias("_sum")).select(key, quality.cast("int").alias("quality"))
