"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import files, metadata, pii, ranges, spans, text, urls
from leafmill.operators import links


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).collect()[0].v


def kinds(spark, t):
    return [(m.kind, m.value) for m in one(spark, pii.find_pii(F.col("t")), t=t)]


@pytest.mark.parametrize(
    "t, want",
    [
        ("Write to ann.lee+x@mail.example.org now", [("email", "ann.lee+x@mail.example.org")]),
        ("Card: 4111 1111 1111 1111 2026, not 4111 1111 1111 1112.", [("card", "4111 1111 1111 1111")]),
        ("IBAN DE89 3704 0044 0532 0130 00 and bad GB00 0000 0000 0000 0000 00", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("SSN 123-45-6789, invalid 000-12-3456", [("ssn", "123-45-6789")]),
        ("AB 12 34 56 C yes, QQ 12 34 56 C no", [("nino", "AB 12 34 56 C")]),
        ("Date of birth: 14/03/1987", [("dob", "14/03/1987")]),
        ("Born on March 3, 1990", [("dob", "March 3, 1990")]),
        ("Invoice date 01/02/2026", []),
        ("192.168.10.254 but 1.2.3.4 and 256.1.1.1", [("ip", "192.168.10.254")]),
        ("+44 20 7946 0958", [("phone", "+44 20 7946 0958")]),
        ("(555) 123-4567", [("phone", "(555) 123-4567")]),
        ("0301 234 5678", [("phone", "0301 234 5678")]),
        ("Total 1,250.00 on 2026-09-28, order 12345678, ref 2026.09.28, qty 10 x 20.", []),
    ],
)
def test_personal_data(spark, t, want):
    assert kinds(spark, t) == want


def test_masking_leaves_nothing(spark):
    t = "a@b.example and 4111 1111 1111 1111, DOB 1990-01-02"
    masked = one(spark, spans.mask_spans(F.col("t"), pii.find_pii(F.col("t"))), t=t)
    assert masked == "[removed] and [removed], DOB [removed]"
    assert kinds(spark, masked) == []


def test_offsets_count_code_points(spark):
    s = one(spark, spans.regex_spans(F.col("t"), "[0-9]+"), t="é😀12 x 3")
    assert [(x.value, x.start, x.stop) for x in s] == [("12", 2, 4), ("3", 7, 8)]


@pytest.mark.parametrize(
    "url, shown, severity, rules, domain",
    [
        ("https://www.example.com/docs?page=2", None, "info", [], "example.com"),
        ("login.secure.example.co.uk", None, "info", [], "example.co.uk"),
        ("https://paypal.com-account.verify.example.xyz/login", None, "high", ["brand", "cheap"], "example.xyz"),
        ("https://www.paypal.com@203.0.113.9/", None, "high", ["userinfo", "ip"], "113.9"),
        ("https://xn--pypal-4ve.com/", None, "high", ["idn"], "pаypal.com"),
        ("http://bit.ly/abc", None, "medium", ["http", "shortener"], "bit.ly"),
        ("https://a.example/out?url=https%3A%2F%2Fevil.test%2F", None, "medium", ["redirect"], "a.example"),
        ("https://evil.test/", "www.mybank.com", "high", ["shown"], "evil.test"),
        ("javascript:alert(1)", None, "high", ["hidden"], None),
        ("mailto:a@b.c", None, "info", ["scheme"], None),
        ("https://", None, "medium", ["invalid"], None),
        ("https://example.zip:8443/", None, "medium", ["file_like", "port"], "example.zip"),
    ],
)
def test_link_rules(spark, url, shown, severity, rules, domain):
    df = spark.createDataFrame([(url, shown)], "url string, shown string")
    r = links.check_links(df, "url", "shown").collect()[0]
    assert (r.severity, [f.rule for f in r.flags], r.domain) == (severity, rules, domain)


def test_qr_payloads(spark):
    r = one(spark, urls.describe_payload(F.col("t")), t=r"WIFI:T:WPA;S:Cafe\;Guest;P:secret;;")
    assert (r.kind, r.details[0]) == ("wifi", "network: Cafe;Guest")
    assert one(spark, urls.describe_payload(F.col("t")), t="otpauth://totp/x?secret=A").severity == "high"


def test_page_lists(spark):
    read = lambda s, n: one(spark, ranges.parse_page_ranges(F.col("s"), F.col("n")), s=s, n=n)
    assert read("1-3, 5; 8-", 9).groups == [[0, 1, 2], [4], [7, 8]]
    assert [read(s, 9).error for s in ("", "x", "0", "10", "5-3", "-")] == ["empty", "invalid", "missing", "missing", "backwards", "invalid"]
    gone = lambda s: one(spark, ranges.pages_to_delete(F.col("s"), F.lit(5)), s=s)
    assert [gone(s) for s in ("1", "-2", "last 2", "last", "4-", "9", "x")] == [[0], [3, 4], [3, 4], [4], [3, 4], [], None]
    assert one(spark, ranges.bates_label(F.lit(1234567), "A-")) == "A-1234567"


def test_numbers_and_text(spark):
    cells = {"1,234.50": 1234.5, "(12)": -12.0, "$ 3": 3.0, "007": None, "1/2": None, "1234567890123456": None, "−4": -4.0, "0.5": 0.5}
    assert {k: one(spark, text.cell_number(F.col("t")), t=k) for k in cells} == cells
    clocks = {"90": 90.0, "1:30": 90.0, "1:02:03.5": 3723.5, "1:75": None, "x": None, "1:60:00": None}
    assert {k: one(spark, text.parse_clock(F.col("t")), t=k) for k in clocks} == clocks
    assert one(spark, text.join_lines(F.array(F.lit("a para-"), F.lit(" graph "), F.lit(""), F.lit("Next")))) == "a paragraph Next"
    assert one(spark, text.decode_entities(F.lit("&lt;&#x41;&#128512;&amp;lt;"))) == "<A😀&lt;"
    assert one(spark, text.password_score(F.lit("Password"))) == 0


def test_files(spark):
    kind = lambda b: one(spark, files.detect_type(F.col("b")), b=bytearray(b))
    assert kind(b"MZ\x90\x00").name == "Windows program"
    assert kind(b"\x00\x00\x00\x18ftypheic").name == "HEIC image"
    assert kind(b"RIFF\x00\x00\x00\x00WEBP").name == "WebP image"
    assert kind(b"\xef\xbb\xbf <!DOCTYPE html>").name == "Web page (HTML)"
    assert kind(b"\x00\x01\x02\x03 binary") is None
    assert one(spark, files.clean_hash(F.lit(" D4:1D 8C-D9"))) == "d41d8cd9"
    assert one(spark, files.format_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, files.decode_text(F.col("b")), b=bytearray("€é".encode("cp1252"))) == "€é"


def test_metadata(spark):
    level = lambda k: one(spark, metadata.classify_key(F.lit(k)))
    assert [level(k) for k in ("GPSLatitude", "xmp:CreatorTool", "dc:creator", "Model", "ExposureTime", "XResolution")] == ["high", "medium", "high", "medium", "low", "low"]
    assert one(spark, metadata.camera_value(F.lit("ExposureTime"), F.lit(1 / 120))) == "1/120 s"
    assert one(spark, metadata.camera_value(F.lit("FocalLength"), F.lit(6.86))) == "6.86 mm"
    assert one(spark, metadata.iso6709(F.lit("+37.7749-122.4194+010.000/"))) == "37.7749, -122.4194 (10 m)"
    assert str(one(spark, metadata.parse_pdf_date(F.lit("D:20260314092653+04'00'")))) == "2026-03-14 05:26:53"


def test_script_markers_after_the_first_megabyte(spark):
    page = F.concat(F.repeat(F.lit("x "), 1 << 20), F.lit("<SCRIPT>"))
    assert one(spark, files.script_markers(page.cast("binary")))
    assert not one(spark, files.script_markers(F.repeat(F.lit("x "), 1 << 20).cast("binary")))
