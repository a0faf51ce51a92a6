"""Links of pages: verdicts, joins with lists, summaries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.urls import extract_urls, normal_url, url_parts, with_verdicts


def unicode_hosts(hosts: DataFrame, host: str = "host") -> DataFrame:
    """``host, shown`` of the distinct hosts with ``xn--`` labels or letters beyond ASCII: what they show. Only these reach Python."""

    def decode(label: str) -> str:
        label = unicodedata.normalize("NFKC", label).lower()
        if not label.startswith("xn--"):
            return label
        try:
            return label[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError):
            return label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [".".join(map(decode, h.split("."))) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown)], names=["host", "shown"])

    odd = hosts.select(F.col(host).alias("host")).filter(F.col("host").rlike(r"(^|\.)xn--|[^\x00-\x7F]")).distinct()
    return odd.mapInArrow(run, "host string, shown string")


def check_links(links: DataFrame, url: str = "url", shown: str | None = None) -> DataFrame:
    """``links`` with ``severity, flags, host, domain``; hosts with ``xn--`` labels are decoded once each and joined back."""
    rows = links.withColumn("_host", url_parts(F.col(url))["host"])
    odd = unicode_hosts(rows, "_host").select(F.col("host").alias("_odd"), F.col("shown").alias("_unicode"))
    rows = rows.join(odd, F.col("_host") == F.col("_odd"), "left")
    return with_verdicts(rows, url, shown, "_unicode").select(*links.columns, "severity", "flags", "host", "domain")


def text_links_not_linked(texts: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Addresses written in ``text`` that are no link's target or shown text on the same page."""
    written = texts.select(key, F.explode(extract_urls(F.col("text"))["value"]).alias("url")).withColumn("_n", normal_url(F.col("url")))
    linked = links.select(key, F.explode(F.array("target", "shown")).alias("_u")).filter("_u is not null").select(key, normal_url(F.col("_u")).alias("_n")).distinct()
    return written.join(linked, [key, "_n"], "left_anti").select(key, "url")


def link_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("links"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.countDistinct("host").alias("hosts"))


def flags_by_rule(checked: DataFrame) -> DataFrame:
    """Counts of each rule's flags. A plain ``explode`` would have the optimizer test for empty flags below it, with all that they are made of written out again and again."""
    flags = checked.select(F.explode_outer("flags").alias("f")).filter("f is not null")
    return flags.groupBy("f.rule", "f.severity").agg(F.count("*").alias("n"))


def distinct_links(links: DataFrame, *columns: str) -> DataFrame:
    return links.select(*columns).dropDuplicates()
