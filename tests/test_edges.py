"""Rows that once stopped a job or gave a wrong answer, each beside a good one."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill import queries
from leafmill.functions.files import text_type
from leafmill.functions.ranges import pages_to_delete, parse_page_ranges
from leafmill.operators import files as file_ops
from leafmill.operators import findings, pages
from leafmill.sources import files, media, metadata


def package(**entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return bytearray(buffer.getvalue())


def test_a_damaged_entry_is_a_row_with_an_error(spark):
    bad = package(one="a" * 500, two="b" * 500)
    bad[40] ^= 0xFF  # in the first entry's data
    df = spark.createDataFrame([("bad", bad), ("good", package(three="c")), ("none", bytearray(b"PK\x03\x04 no package"))], "path string, content binary")
    rows = {(r.path, r.part): (r.bytes, r.error) for r in files.package_parts(df).collect()}
    assert rows["good", "three"] == (b"c", None) and rows["bad", "two"] == (b"b" * 500, None)
    assert rows["bad", "one"][0] is None and rows["bad", "one"][1]
    assert len(rows) == 3


def test_packets_of_unknown_encoding(spark):
    packets = [b'<?xml version="1.0" encoding="nope"?><a b="c"/>', b'<?xml version="1.0" encoding="shift_jis"?><a b="c"/>', b'<a b="c"/>']
    assert [metadata.xmp_properties(p) for p in packets][2] == [("b", "c")]


def test_any_rotation(spark):
    turns = ["90", "1e300", "-90", "Infinity", "NaN", "x", "450"]
    probes = [(k, json.dumps({"streams": [{"codec_type": "video", "width": 3, "height": 2, "tags": {"rotate": t}}]})) for k, t in enumerate(turns)]
    got = {r.k: r.rotation for r in media.track_facts(spark.createDataFrame(probes, "k int, json string"), "k").collect()}
    assert [got[k] for k in (0, 2, 3, 4, 5, 6)] == [90, 270, 0, 0, 0, 90] and got[1] in (0, 90, 180, 270)


def test_page_numbers_too_large_to_count(spark):
    df = spark.createDataFrame([("99999999999999999999",), ("2-99999999999999999999",), ("2-3",), ("-",)], "s string")
    r = [x for x in df.select(parse_page_ranges(F.col("s"), F.lit(5)).alias("r"), pages_to_delete(F.col("s"), F.lit(5)).alias("d")).collect()]
    assert [x.r.error for x in r] == ["missing", "missing", None, "invalid"]
    assert [x.d for x in r[:3]] == [[], [1, 2, 3, 4], [1, 2]]


def test_pages_put_before_the_first(spark):
    own = spark.createDataFrame([("a", 0), ("a", 1)], "doc string, page long")
    got = pages.insert_pages(own, spark.createDataFrame([("a", 0)], "doc string, page long"), -1)
    assert sorted(r["at"] for r in got.collect()) == [0, 1, 2]


def test_binary_data_behind_clean_bytes(spark):
    contents = [b"a" * 5000, b"a" * 5000 + b"\xff\xfe\xfa", b"a" * 5000 + b"\0", b"\xff\xfea\0b\0", b" " * 6000 + b"<!doctype html>"]
    df = spark.createDataFrame([(bytearray(c),) for c in contents], "c binary")
    assert [r[0] and r[0]["name"] for r in df.select(text_type(F.col("c"))).collect()] == ["Plain text", None, None, "Plain text", "Web page (HTML)"]


def test_tools_by_equality(spark):
    df = spark.createDataFrame([(1, "pdf"), (2, "text"), (3, None), (4, "unknown")], "id_ int, kind string")
    tools = spark.createDataFrame([("merge", ["pdf", "pdf"]), ("hash", ["unknown", "pdf"]), ("read", ["text", "pdf"])], "id string, accepts array<string>")
    out = file_ops.tools_for(df, tools)
    assert sorted((r.id_, r.id) for r in out.collect()) == [(1, "hash"), (1, "merge"), (1, "read"), (2, "hash"), (2, "read"), (3, "hash"), (4, "hash")]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_query_is_registered_once(monkeypatch):
    own, sql = queries.collect()
    assert {"report_lines", "report_written"} <= own.keys() & sql.keys()
    from leafmill.queries import pii

    monkeypatch.setattr(pii, "QUERIES", pii.QUERIES | {"report_written": None})
    with pytest.raises(ValueError, match="report_written"):
        queries.collect()


@pytest.mark.parametrize("short, most", [(-1, -1), (-1, 4_000_000), (200_000, 4_000_000)])
def test_known_hashes_with_and_without_bitmaps(spark, monkeypatch, short, most):
    monkeypatch.setattr(file_ops, "SHORT", short)
    monkeypatch.setattr(file_ops, "MOST_KNOWN", most)
    rows = [(k, f"text {k}".encode()) for k in range(3000)]
    hashed = file_ops.with_hashes(spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "id int, content binary"), F.col("content")).drop("content")
    known = [(hashlib.md5(c).hexdigest().upper(),) for k, c in rows if k % 100 == 3] + [(hashlib.sha256(c).hexdigest(),) for k, c in rows if k % 200 == 3] + [("no hash",), (None,), ("00" * 16,)]
    got = file_ops.match_hashes(hashed, spark.createDataFrame(known, "hash string"), "id").collect()
    assert sorted((r.id, r.algorithm) for r in got) == [(k, "sha256" if k % 200 == 3 else "md5") for k, _ in rows if k % 100 == 3]
    assert file_ops.match_hashes(hashed, spark.createDataFrame([], "hash string"), "id").count() == 0


def test_bitmaps_keep_few_other_files(spark):
    known = spark.createDataFrame([(hashlib.md5(str(k).encode()).hexdigest(),) for k in range(5000)], "hash string")
    other = spark.createDataFrame([(hashlib.md5(f"x{k}".encode()).hexdigest(),) for k in range(5000)], "hash string")
    may = file_ops._may_be_known(known, 5000)
    assert known.filter(may("hash")).count() == 5000 and other.filter(may("hash")).count() < 600


def test_addresses_of_very_many_labels(spark):
    texts = ["x@" + "a." * 20000 + "com", "b@c.de", "x@" + "a." * 120 + "com", "b@c.de..fg"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    assert sorted((r.doc_id, r.value) for r in findings.pii_findings(rows, ["email"]).collect()) == [(1, "b@c.de"), (2, texts[2]), (3, "b@c.de")]
