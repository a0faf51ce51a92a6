"""Media probes (JSON) as tables: files, tracks and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.metadata import detail_group, iso6709

# What a probe tells, and the colour transfers of pictures of high dynamic range.
_STREAM = (
    "struct<index:int,codec_name:string,codec_type:string,codec_tag_string:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,channels:int,sample_rate:string,"
    "bit_rate:string,bits_per_raw_sample:string,color_transfer:string,side_data_list:array<struct<rotation:double>>,tags:map<string,string>,disposition:map<string,int>>"
)
PROBE = f"streams array<{_STREAM}>, format struct<format_name:string,format_long_name:string,duration:string,bit_rate:string,tags:map<string,string>>, chapters array<struct<tags:map<string,string>>>"
HDR = ["smpte2084", "arib-std-b67"]


def _probe(df: DataFrame, key: str, json: str) -> DataFrame:
    p = df.select(key, F.from_json(json, PROBE).alias("p")).select(key, "p.*")
    return p.withColumn("streams", F.coalesce("streams", F.array().cast(f"array<{_STREAM}>")))


def _cover(s: Column) -> Column:
    return (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 1)


def _positive(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(value > 0, value)


def parse_probe(df: DataFrame, key: str, json: str = "json") -> DataFrame:
    """Tracks by kind, cover pictures, bit rate, and the duration (of the file, else of its longest track) from a media probe's JSON."""
    s = F.col("streams")
    count = lambda kind: F.size(F.filter(s, lambda x: (x["codec_type"] == kind) & ~_cover(x)))
    longest = F.array_max(F.transform(s, lambda x: _positive(x["duration"])))
    return _probe(df, key, json).select(
        key, F.coalesce("format.format_long_name", "format.format_name", F.lit("unknown")).alias("format"), F.coalesce(_positive(F.col("format.duration")), longest).alias("duration"),
        _positive(F.col("format.bit_rate")).alias("bit_rate"), count("video").alias("video"), count("audio").alias("audio"), count("subtitle").alias("subtitles"), F.exists(s, _cover).alias("cover"),
    )


def frame_rate(rate: Column) -> Column:
    """``30000/1001`` as 29.97: frames a second to three places, null for none and for a thousand and more."""
    value = F.try_divide(F.substring_index(rate, "/", 1).try_cast("double"), F.coalesce(F.nullif(F.regexp_extract(rate, "/(.*)$", 1).try_cast("double"), F.lit(0.0)), F.lit(1.0)))
    return F.when((value > 0) & (value < 1000), F.floor(value * 1000 + 0.5) / 1000)


def track_facts(df: DataFrame, key: str, json: str = "json") -> DataFrame:
    """A row for each track: ``kind`` (cover for pictures), ``codec``, upright ``width`` and ``height``, ``rotation`` in quarter turns, ``fps``,
    ``hdr``, ``channels``, ``sample_rate``, ``bit_rate``, ``bit_depth``."""
    t = _probe(df, key, json).select(key, F.posexplode("streams").alias("track", "s"))
    matrix = F.get(F.filter("s.side_data_list", lambda d: d["rotation"].isNotNull()), F.lit(0))["rotation"]
    degrees = F.coalesce(matrix, F.col("s.tags")["rotate"].try_cast("double"), F.lit(0.0))
    degrees = F.when(F.isnan(degrees) | (F.abs(degrees) == float("inf")), F.lit(0.0)).otherwise(F.pmod(degrees, F.lit(360.0)))
    turn = F.pmod((F.floor(degrees / 90 + 0.5) * 90).cast("int"), F.lit(360))
    video, sideways = F.col("s.codec_type") == "video", F.col("rotation").isin(90, 270)
    t = t.withColumn("rotation", F.when(video, turn))
    size = lambda own, other: F.when(video, F.coalesce(F.when(sideways, F.col(f"s.{other}")).otherwise(F.col(f"s.{own}")), F.lit(0)))
    return t.select(
        key, "track", F.when(_cover(F.col("s")), "cover").otherwise(F.col("s.codec_type")).alias("kind"), F.coalesce("s.codec_name", F.lit("unknown")).alias("codec"), size("width", "height").alias("width"), size("height", "width").alias("height"),
        "rotation", F.when(video, F.coalesce(frame_rate(F.col("s.avg_frame_rate")), frame_rate(F.col("s.r_frame_rate")))).alias("fps"), F.when(video, F.coalesce(F.col("s.color_transfer").isin(HDR), F.lit(False))).alias("hdr"),
        F.when(F.col("s.codec_type") == "audio", F.coalesce("s.channels", F.lit(2))).alias("channels"), *[_positive(F.col(f"s.{c}")).alias(a) for c, a in (("sample_rate", "sample_rate"), ("bit_rate", "bit_rate"), ("bits_per_raw_sample", "bit_depth"))],
    )


def media_tags(df: DataFrame, key: str, json: str = "json") -> DataFrame:
    """``key, place, grp, tag, value``: the tags of the file, its tracks and chapters, without technical ones; places on Earth are written out."""
    kind = lambda s: F.when(_cover(s), "cover").when(s["codec_type"].isin("video", "audio", "subtitle"), F.concat(s["codec_type"], F.lit(" track"))).otherwise("data track")
    none = F.create_map().cast("map<string,string>")
    row = lambda place, tags: F.struct(place.alias("place"), F.coalesce(tags, none).alias("tags"))
    chapters = F.transform(F.coalesce("chapters", F.array().cast("array<struct<tags:map<string,string>>>")), lambda c, i: row(F.concat(F.lit("chapter "), (i + 1).cast("string")), c["tags"]))
    places = F.concat(F.array(row(F.lit("file"), F.col("format.tags"))), F.transform("streams", lambda s: row(kind(s), s["tags"])), chapters)
    t = _probe(df, key, json).select(key, F.inline(places)).select(key, "place", F.explode("tags").alias("tag", "value"))
    t = t.select(key, "place", detail_group(F.col("tag")).alias("grp"), "tag", F.trim("value").alias("value")).filter("grp is not null and value <> ''")
    return t.withColumn("value", F.coalesce(F.when(F.col("grp") == "location", iso6709(F.col("value"))), "value"))


def media_summary(df: DataFrame, key: str, json: str = "json") -> DataFrame:
    """``parse_probe`` with ``groups``, the sorted groups of tags that a file holds."""
    groups = media_tags(df, key, json).groupBy(key).agg(F.array_sort(F.collect_set("grp")).alias("groups"))
    return parse_probe(df, key, json).join(groups, key, "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
