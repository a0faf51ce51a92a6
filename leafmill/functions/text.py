"""Text and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common passwords, and how numbers in cells look.
COMMON = "password passw0rd 123456 12345678 123456789 1234567890 qwerty qwertyuiop abc123 letmein welcome admin iloveyou monkey dragon football baseball sunshine princess master shadow trustno1 111111 000000 secret changeme p@ssw0rd login starwars".split()
NUMBER = r"^(\()?([-+−])?\s?([$€£¥])?\s?(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?(\))?$"
#: Marks that no sentence stands before are a part of their own, so that no text is lost.
SENTENCE = r"[^.!?。！？]+[.!?。！？]*\s*|[.!?。！？]+\s*"
CLOCK = r"^\d+(:\d+){0,2}(\.\d+)?$"
_CHUNKS = "struct<part:string,out:array<string>>"


def escape_markdown(text: Column) -> Column:
    text = F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")
    text = F.regexp_replace(text, r"^(\s*)([#+-])(\s)", r"$1\\$2$3")
    return F.regexp_replace(text, r"^(\s*\d+)([.)])(\s)", r"$1\\$2$3")


def cell_number(text: Column) -> Column:
    """The number that a cell shows, like ``1,234.50``, ``(12)`` or ``$ 3``; null where it stays text (ids, dates, long numbers)."""
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, NUMBER, k)
    whole, fraction = F.replace(part(4), F.lit(","), F.lit("")), part(5)
    good = t.rlike(NUMBER) & ((part(1) != "") == (part(6) != "")) & ~(whole.rlike("^0.") & (fraction == "")) & (F.length(whole) + F.length(fraction) <= 15)
    value = F.concat(whole, fraction).try_cast("double")
    return F.when(good, F.when((part(1) != "") | part(2).isin("-", "−"), -value).otherwise(value))


def join_lines(lines: Column) -> Column:
    """Lines as one text; a word that was hyphenated at a line's end is joined again."""
    lines = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        cut = acc.rlike(r"\p{L}-$") & line.rlike(r"^\p{Ll}")
        return F.when(acc == "", line).when(cut, F.concat(F.regexp_replace(acc, "-$", ""), line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), step)


def sentence_chunks(text: Column, most: int = 1000) -> Column:
    """Sentences packed into chunks of at most ``most`` characters; longer sentences are cut at their last space before it."""

    def cut_long(acc: Column) -> Column:
        # each step cuts one chunk off a part that is too long
        times = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(acc["part"]) / F.lit(most)).cast("int") * 2))

        def step(a: Column, _: Column) -> Column:
            head = F.substring(a["part"], 1, most + 1)
            space = F.length(head) - F.instr(F.reverse(head), " ")
            at = F.when((F.instr(head, " ") > 0) & (space > 0), space).otherwise(most)
            longer = F.struct(F.substring(a["part"], at + 1, F.length(a["part"])).alias("part"), F.concat(a["out"], F.array(F.trim(F.substring(a["part"], F.lit(1), at)))).alias("out"))
            return F.when(F.length(a["part"]) > most, longer).otherwise(a)

        return F.when(F.length(acc["part"]) > most, F.aggregate(times, acc, step)).otherwise(acc)

    def add(acc: Column, sentence: Column) -> Column:
        full = (acc["part"] != "") & (F.length(acc["part"]) + F.length(sentence) > most)
        grown = F.struct(
            F.when(full, sentence).otherwise(F.concat(acc["part"], sentence)).alias("part"),
            F.when(full, F.concat(acc["out"], F.array(F.trim(acc["part"])))).otherwise(acc["out"]).alias("out"),
        )
        return cut_long(grown)

    start = F.struct(F.lit("").alias("part"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), start, add, lambda a: F.filter(F.concat(a["out"], F.array(F.trim(a["part"]))), lambda x: x != ""))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(done)


def has_words(text: Column) -> Column:
    return text.rlike(r"\p{L}{2}")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def parse_clock(text: Column) -> Column:
    """Seconds of ``90``, ``1:30`` or ``1:02:03.5``; null for anything else."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    parts = F.split(t, ":")
    n = F.size(parts)
    last, minutes, hours = (F.get(parts, n - k).try_cast("double") for k in (1, 2, 3))
    good = t.rlike(CLOCK) & ((n == 1) | (last < 60)) & ((n < 3) | (minutes < 60))
    return F.when(good, F.coalesce(hours, F.lit(0.0)) * 3600 + F.coalesce(minutes, F.lit(0.0)) * 60 + last)


def format_clock(seconds: Column) -> Column:
    total = F.greatest(F.lit(0), F.round(seconds)).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    tail = F.lpad(s.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0"), tail)).otherwise(F.concat_ws(":", m.cast("string"), tail))


def password_score(text: Column) -> Column:
    """0 to 4 by bits: the pool of characters times the length, characters that go on a run counting a quarter."""
    pools = [("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), (r"[^\w\s]|_", 33), (r"\s", 1), (r"[^\x00-\x7F]", 100)]
    pool = sum((F.when(text.rlike(p), n).otherwise(0) for p, n in pools), F.lit(0))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    steps = F.transform(codes, lambda c, i: F.when((i == 0) | (F.abs(c - F.get(codes, i - 1)) > 1), 1.0).otherwise(0.25))
    bits = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) * F.log2(F.greatest(pool, F.lit(2)))
    by_bits = F.when(bits < 28, 0).when(bits < 40, 1).when(bits < 60, 2).when(bits < 80, 3).otherwise(4)
    return F.when((text == "") | F.lower(text).isin(COMMON), 0).otherwise(by_bits)


def decode_entities(text: Column) -> Column:
    """XML entities as their characters; numbers that are no character, like those of half a surrogate pair, stay as they are."""
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = F.regexp_replace(text, f"(?i)&{name};", mark)
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(x[0-9a-f]+|[0-9]+);"), F.lit(1)))

    def one(acc: Column, n: Column) -> Column:
        hexa = F.lower(n).startswith("x")
        digits = F.regexp_replace(F.substring(n, F.when(hexa, 2).otherwise(1), F.length(n)), "^0+(?=.)", "")
        code = F.when(F.length(digits) < 8, F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits)).try_cast("int")
        # UTF-16 of the code point, so that all of Unicode is reached
        low = code - 65536
        pair = F.concat(F.unhex(F.lpad(F.hex(F.lit(55296) + F.shiftright(low, 10)), 4, "0")), F.unhex(F.lpad(F.hex(F.lit(56320) + low.bitwiseAND(1023)), 4, "0")))
        shown = F.decode(F.when(code < 65536, F.unhex(F.lpad(F.hex(code), 4, "0"))).otherwise(pair), "UTF-16BE")
        good = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(F.coalesce(good, F.lit(False)), F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), shown)).otherwise(acc)

    return F.regexp_replace(F.aggregate(numbers, text, one), "(?i)&amp;", "&")


def plural_category(n: Column, lang: Column) -> Column:
    """The plural category of a whole number in en, es, fr, de and ar."""
    tens = n % 100
    arabic = F.when(n == 0, "zero").when(n == 1, "one").when(n == 2, "two").when(tens.between(3, 10), "few").when(tens.between(11, 99), "many").otherwise("other")
    million = (n != 0) & (n % 1000000 == 0)
    return F.when(lang == "ar", arabic).when(lang == "fr", F.when(n < 2, "one").when(million, "many").otherwise("other")).when(lang == "es", F.when(n == 1, "one").when(million, "many").otherwise("other")).otherwise(F.when(n == 1, "one").otherwise("other"))


def plural_form(n: Column, lang: Column, forms: Column) -> Column:
    """The catalogue's form (a map by category) for a number, ``{n}`` filled in; that of ``other`` where the category has none."""
    form = F.coalesce(F.try_element_at(forms, plural_category(n, lang)), F.try_element_at(forms, F.lit("other")))
    return F.replace(form, F.lit("{n}"), n.cast("string"))


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿?---\\r?\\n[\\s\\S]*?\\r?\\n---\\r?\\n", "")


def data_url(url: Column) -> Column:
    """``type, bytes`` of a ``data:`` URL, null for anything else."""
    pattern = r"(?is)^data:([^;,]*)((?:;[^;,]*)*),(.*)$"
    t = F.trim(url)
    kind, options, body = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3))
    plain = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary")
    content = F.when(options.rlike("(?i);base64"), F.try_to_binary(F.regexp_replace(body, r"\s+", ""), F.lit("base64"))).otherwise(plain)
    return F.when(t.rlike(pattern) & content.isNotNull(), F.struct(F.lower(kind).alias("type"), content.alias("bytes")))


def expand_tabs(line: Column, stop: int = 4) -> Column:
    """Tabs as spaces up to the next multiple of ``stop`` columns."""
    parts = F.split(line, "\t", -1)
    filled = lambda acc: F.concat(acc, F.repeat(F.lit(" "), F.lit(stop) - F.length(acc) % stop))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), lambda acc, p: F.concat(filled(acc), p))


def text_blocks(texts: DataFrame, key: str, text: str, mono: bool = False) -> DataFrame:
    """``key, seq, text``: a block for each line, an empty one as a space; tabs go to stops of four columns where ``mono``, else they are four spaces.

    Empty lines at the end are left out; a null text has no blocks.
    """
    whole = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n+$", "")
    shown = (lambda x: expand_tabs(x)) if mono else (lambda x: F.replace(x, F.lit("\t"), F.lit("    ")))
    lines = F.transform(F.split(whole, "\n", -1), lambda x: F.coalesce(F.nullif(shown(x), F.lit("")), F.lit(" ")))
    return texts.select(key, F.posexplode(lines).alias("seq", "text"))
