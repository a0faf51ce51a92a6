"""Metadata: how sensitive an entry is, how it is shown, and what media tags mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of keys by sensitivity, exact keys, technical tags and group rules.
HIGH = "gps latitude longitude altitude location city country state province sublocation address postal author artist creator byline owner copyright rights credit contact email phone person people lastmodifiedby company manager serial hostcomputer usercomment thumbnail attachment embeddedfile annotationauthor revision makernote cameraowner imageuniqueid".split()
MEDIUM = "make model lens software producer tool agent application date time created modified history documentid instanceid derivedfrom title subject description caption headline keywords comment rating javascript action uuid xmptk trapped".split()
EXACT = {"creatortool": "medium", "xmpcreatortool": "medium", "exposuretime": "low", "subsectime": "low", "subsectimeoriginal": "low", "subsectimedigitized": "low", "offsettime": "medium", "colorspace": "low", "orientation": "low"}
TECHNICAL_IMAGE = [0x011A, 0x011B, 0x0128, 0x0213]
TECHNICAL_EXIF = [
    0x829A, 0x829D, 0x8822, 0x8827, 0x8830, 0x8832, 0x9000, 0x9101, 0x9201, 0x9202, 0x9203, 0x9204, 0x9205, 0x9206, 0x9207, 0x9208, 0x9209, 0x920A,
    0xA000, 0xA001, 0xA002, 0xA003, 0xA217, 0xA401, 0xA402, 0xA403, 0xA404, 0xA405, 0xA406, 0xA407, 0xA408, 0xA409, 0xA40A, 0xA40C,
]
MEDIA_TECHNICAL = "^(major_brand|minor_version|compatible_brands|handler_name|vendor_id|language|rotate|duration|bps|number_of_frames|number_of_bytes|_statistics_tags|mimetype|filename|encoder_options)$"
GROUPS = {
    "location": "location|xyz|gps|iso6709|latitude|longitude|coordinates|place",
    "device": "make|model|manufacturer|camera|lens|device|serial",
    "software": r"encoder|encoded_by|software|writing_app|application|tool|android\.version|^version$",
    "dates": "date|creation_time|time$|year|timecode",
    "text": "title|artist|author|album|composer|performer|publisher|copyright|comment|description|synopsis|lyrics|genre|keywords|owner|creator|director|producer|show|episode|network|grouping|track|disc|sort|purl|rating|subject",
}
EDITORS = r"(?i)photoshop|lightroom|gimp|affinity|pixelmator|snapseed|canva|picsart|facetune|luminar|capture one|darktable|paint\.net|photopea|fotor|vsco|meitu|remini|airbrush|photodirector|skylum|corel"
AI_TOOLS = r"(?i)midjourney|dall[·.\s-]?e|stable diffusion|firefly|imagen|bing image creator|novelai|leonardo|ideogram|flux|comfyui|automatic1111|invokeai|dreamstudio|craiyon|openai|gemini|grok"
AI_SOURCE = "trainedAlgorithmicMedia|compositeWithTrainedAlgorithmicMedia|algorithmicMedia"
AI_KEYS = ["parameters", "prompt", "workflow", "invokeai_metadata", "sd-metadata", "dream", "negative_prompt", "comfyui"]
RENDERING_CHUNKS = "IHDR PLTE IDAT IEND tRNS gAMA cHRM sRGB sBIT bKGD hIST pHYs sPLT acTL fcTL fdAT cICP mDCv cLLi mDCV cLLI".split()


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def classify_key(key: Column, label: Column | None = None) -> Column:
    """``high``, ``medium`` or ``low``: exact keys first, then parts of the key or label."""
    k, local = _letters(key), _letters(F.substring_index(key, ":", -1))
    both = F.concat_ws("\n", k, _letters(label if label is not None else key))
    exact = F.coalesce(*[F.when((k == e) | (local == e), F.lit(s)) for e, s in EXACT.items()])
    return F.coalesce(exact, F.when(both.rlike("|".join(HIGH)), "high").when(both.rlike("|".join(MEDIUM)), "medium").otherwise("low"))


def humanize_key(key: Column) -> Column:
    """``CreatorTool`` as ``Creator Tool``, ``dc:creator`` as ``Creator``."""
    t = F.regexp_replace(F.substring_index(key, ":", -1), "[_-]+", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"([a-z\d])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def format_values(values: Column, most: int = 2000) -> Column:
    """An array's values as one text."""
    return format_value(F.array_join(values, ", "), most)


def format_value(value: Column, most: int = 2000) -> Column:
    t = F.trim(F.regexp_replace(value, "\\u0000+$", ""))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def camera_value(key: Column, value: Column) -> Column:
    """Camera settings as cameras show them: ``1/120 s``, ``f/1.8``, ``6.86 mm``; other values as text."""
    two = F.regexp_replace((F.floor(value * 100 + 0.5) / 100).cast("string"), r"\.0$", "")
    exposure = F.when(value < 1, F.concat(F.lit("1/"), F.floor(1 / value + 0.5).cast("string"), F.lit(" s"))).otherwise(F.concat(two, F.lit(" s")))
    shown = F.when(key == "ExposureTime", exposure).when(key == "FNumber", F.concat(F.lit("f/"), two)).when(key.isin("FocalLength", "FocalLengthIn35mmFormat"), F.concat(two, F.lit(" mm")))
    return F.when((value > 0) & shown.isNotNull(), shown).otherwise(value.cast("string"))


def technical_tag(tag: Column, block: Column) -> Column:
    """Whether a tag says only how a picture was taken or is shown; ``block`` is ``image`` or ``exif``."""
    return F.when(block == "image", tag.isin(TECHNICAL_IMAGE)).otherwise(tag.isin(TECHNICAL_EXIF))


def detail_group(key: Column) -> Column:
    """The group of a media tag, null for technical ones."""
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(key), r"^com\.apple\.quicktime\.", ""), r"^com\.", ""), "-[a-z]{3}$", "")
    groups = F.coalesce(*[F.when(short.rlike(p), F.lit(g)) for g, p in GROUPS.items()], F.lit("other"))
    return F.when(~short.rlike(MEDIA_TECHNICAL), groups)


def iso6709(text: Column) -> Column:
    """``+37.77-122.41+010/`` as ``37.77, -122.41 (10 m)``; null where it is no place on Earth."""
    pattern = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?(?:CRS[^/]*)?/?$"
    t = F.trim(text)
    lat, lon, alt = (F.regexp_extract(t, pattern, k).try_cast("double") for k in (1, 2, 3))
    plain = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    shown = F.concat(plain(lat), F.lit(", "), plain(lon), F.coalesce(F.concat(F.lit(" ("), F.floor(alt + 0.5).cast("string"), F.lit(" m)")), F.lit("")))
    return F.when(t.rlike(pattern) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), shown)


def parse_pdf_date(text: Column) -> Column:
    """``D:20260314092653+04'00'`` as a timestamp; missing parts are the first month, day and so on."""
    pattern = r"^D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Zz+-])?(\d{2})?'?(\d{2})?"
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(F.trim(text), pattern, k), F.lit("")), F.lit(default))
    sign = F.upper(part(7, "Z"))
    zone = F.when(sign == "Z", "+00:00").otherwise(F.concat(sign, part(8, "00"), F.lit(":"), part(9, "00")))
    iso = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), zone)
    return F.when(F.trim(text).rlike(pattern), F.try_to_timestamp(iso))


def parse_exif_date(text: Column) -> Column:
    pattern = r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):?(\d{2})?"
    part = lambda k: F.regexp_extract(F.trim(text), pattern, k)
    iso = F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), F.concat_ws(":", part(4), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))))
    return F.when(F.trim(text).rlike(pattern), F.try_to_timestamp(iso))


def editor_flags(key: Column, value: Column) -> Column:
    """``ai``, ``editor`` or ``software`` where an entry says so, else null."""
    maker = key.rlike("(?i)software|creatortool|make|model|description|comment|artist")
    ai = value.rlike(AI_SOURCE) | F.lower(key).isin(AI_KEYS) | (maker & value.rlike(AI_TOOLS))
    software = key.rlike("(?i)^(software|creatortool|xmp:creatortool|processingsoftware|hostcomputer)$") | key.rlike("(?i)softwareAgent")
    return F.when(ai, "ai").when(software & value.rlike(EDITORS), "editor").when(software, "software")
