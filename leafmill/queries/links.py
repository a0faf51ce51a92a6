"""Addresses and links of ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.operators import links as ops
from leafmill.sources.html import html_blocks
from leafmill.sources.tables import read_table


def _pages(spark, sf_dir, *columns):
    return read_table(spark, sf_dir, "pages", *columns)


def _shown(spark, sf_dir):
    """Pages with made-up links: every seventh imitates a brand, passes on, or shows another name."""
    id_, u = F.col("page_id"), F.col("url")
    target = (
        F.when(id_ % 7 == 1, F.concat(F.lit("https://paypal.com-check.example.xyz/p"), id_))
        .when(id_ % 7 == 2, F.concat(F.lit("https://www.apple.com@203.0.113.9/"), id_))
        .when(id_ % 7 == 3, F.concat(F.regexp_replace(u, "#.*$", ""), F.when(u.contains("?"), "&").otherwise("?"), F.lit("next=https%3A%2F%2Fevil.test%2F")))
        .when(id_ % 7 == 4, F.concat(F.lit("javascript:go("), id_, F.lit(")")))
        .when(id_ % 7 == 5, F.lit("http://bit.ly:8080/x"))
        .otherwise(u)
    )
    return _pages(spark, sf_dir, "page_id", "url").select("page_id", target.alias("url"), F.when(id_ % 7 == 6, "www.mybank.com").alias("shown"))


def blocks(spark, sf_dir):
    """Blocks of each page by kind."""
    b = html_blocks(_pages(spark, sf_dir, "page_id", "html"))
    return b.filter("kind in ('heading', 'item', 'link')").groupBy("page_id", "kind", "level").agg(F.count("*").alias("n"))


def block_texts(spark, sf_dir):
    """What a reader sees of each page, by kind, in the words and the order of the page."""
    b = html_blocks(_pages(spark, sf_dir, "page_id", "html")).filter("kind in ('heading', 'item', 'paragraph')")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda x: F.concat(x["kind"], F.lit(": "), x["text"]))
    return b.groupBy("page_id").agg(F.array_join(lines, "\n").alias("lines"))


def headings(spark, sf_dir):
    return html_blocks(_pages(spark, sf_dir, "page_id", "html")).filter("kind = 'heading' and level = 1").select("page_id", "text")


def anchors(spark, sf_dir):
    return html_blocks(_pages(spark, sf_dir, "page_id", "html")).filter("kind = 'link'").select("page_id", "target", "text")


def parts(spark, sf_dir):
    p = urls.url_parts(F.col("url"))
    return _pages(spark, sf_dir, "page_id", "url").select("page_id", p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"), p["port"].alias("port"))


def normal(spark, sf_dir):
    return _pages(spark, sf_dir, "page_id", "url").select("page_id", urls.normal_url(F.upper("url")).alias("url"))


def domains(spark, sf_dir):
    host = urls.url_parts(F.col("url"))["host"]
    wide = F.concat(F.lit("a.b."), host, F.when(F.col("page_id") % 3 == 0, ".co.uk").otherwise(""))
    return _pages(spark, sf_dir, "page_id", "url").select("page_id", urls.registrable_domain(wide).alias("domain"))


def in_text(spark, sf_dir):
    """Addresses written in pages, with positions."""
    text = F.concat(F.lit("See "), F.col("url"), F.lit(", or (www.example.org/a)."))
    return _pages(spark, sf_dir, "page_id", "url").select("page_id", F.explode(urls.extract_urls(text)).alias("u")).select("page_id", "u.value", "u.start", "u.stop")


def verdicts(spark, sf_dir):
    c = ops.check_links(_shown(spark, sf_dir), "url", "shown")
    return c.select("page_id", "severity", F.array_join(F.array_sort(F.col("flags.rule")), ",").alias("rules"), "domain")


def disguised(spark, sf_dir):
    """Hosts in two scripts, in one beyond ASCII (as punycode and as letters), and in ASCII, before each page's own path: what they show, and how bad it is."""
    id_ = F.col("page_id")
    host = F.element_at(F.array(*map(F.lit, ("xn--pypal-4ve.com", "xn--bcher-kva.example", "bücher.example", "books.example"))), (id_ % 4 + 1).cast("int"))
    u = _pages(spark, sf_dir, "page_id", "url").select("page_id", F.concat(F.lit("https://"), host, F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)?", 1)).alias("url"))
    idn = F.get(F.filter("flags", lambda f: f["rule"] == "idn"), F.lit(0))
    return ops.check_links(u).select("page_id", "host", idn["severity"].alias("idn"), idn["detail"].alias("shows"))


def summary(spark, sf_dir):
    return ops.link_summary(ops.check_links(_shown(spark, sf_dir), "url", "shown"))


def by_rule(spark, sf_dir):
    return ops.flags_by_rule(ops.check_links(_shown(spark, sf_dir), "url", "shown"))


def not_linked(spark, sf_dir):
    pages = _pages(spark, sf_dir, "page_id", "url")
    texts = pages.select("page_id", F.concat(F.lit("at "), F.col("url"), F.lit(" and www.example.org/b")).alias("text"))
    links = pages.filter("page_id % 2 = 0").select("page_id", F.upper("url").alias("target"), F.lit("example.org/b/").alias("shown"))
    return ops.text_links_not_linked(texts, links, "page_id")


def distinct(spark, sf_dir):
    return ops.distinct_links(_pages(spark, sf_dir, "url").select(urls.url_parts(F.col("url"))["host"].alias("host")), "host")


def payloads(spark, sf_dir):
    """What codes with page addresses and ids in them would do."""
    id_ = F.col("page_id").cast("string")
    raw = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("WIFI:T:WPA;S:Net"), id_, F.lit("\\;x;P:s;;")))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("mailto:a"), id_, F.lit("@b.c?subject=x")))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("otpauth://totp/Me%20"), id_, F.lit("?secret=A")))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("BCD\n1\n2\n3\n4\nShop\nDE"), id_, F.lit("\n")))
        .otherwise(F.concat(F.lit("note "), id_))
    )
    d = urls.describe_payload(raw)
    return _pages(spark, sf_dir, "page_id").select("page_id", d["kind"].alias("kind"), F.array_join(d["details"], "|").alias("details"), d["severity"].alias("severity"))


QUERIES = {
    "html_blocks": blocks,
    "html_texts": block_texts,
    "link_disguised": disguised,
    "html_headings": headings,
    "html_anchors": anchors,
    "url_parts": parts,
    "url_normal": normal,
    "url_domains": domains,
    "url_in_text": in_text,
    "link_verdicts": verdicts,
    "link_summary": summary,
    "link_rules": by_rule,
    "links_not_linked": not_linked,
    "links_distinct": distinct,
    "qr_payloads": payloads,
}

#: Character references as HTML reads them: these need no semicolon. That of the ampersand comes last, so nothing is read twice.
_REFERENCES = {"quot": '"', "#x27": "''", "#39": "''", "lt": "<", "gt": ">", "copy": "©", "middot": "·", "nbsp": "\u00a0", "amp": "&"}


def _seen(text: str) -> str:
    """SQL for what a reader sees of the text between tags, with single spaces."""
    for name, sign in _REFERENCES.items():
        text = f"regexp_replace({text}, '&{name};?', '{sign}', 'g')"
    return rf"trim(regexp_replace({text}, '[\s\x{{A0}}]+', ' ', 'g'))"


_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)"
_V = f"""v AS (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'medium' WHEN 6 THEN 'high' ELSE CASE WHEN url LIKE 'http:%' THEN 'medium' ELSE 'info' END END AS severity,
  CASE page_id % 7 WHEN 1 THEN ['brand', 'cheap'] WHEN 2 THEN ['ip', 'userinfo'] WHEN 3 THEN CASE WHEN url LIKE 'http:%' THEN ['http', 'redirect'] ELSE ['redirect'] END WHEN 4 THEN ['hidden'] WHEN 5 THEN ['http', 'port', 'shortener']
    WHEN 6 THEN CASE WHEN url LIKE 'http:%' THEN ['http', 'shown'] ELSE ['shown'] END ELSE CASE WHEN url LIKE 'http:%' THEN ['http'] ELSE []::VARCHAR[] END END AS rules,
  CASE page_id % 7 WHEN 1 THEN 'paypal.com-check.example.xyz' WHEN 2 THEN '203.0.113.9' WHEN 4 THEN NULL WHEN 5 THEN 'bit.ly' ELSE {_HOST} END AS host FROM pages),
d AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM v)"""
SQL = {
    "html_blocks": r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style|head)\b.*?</(script|style|head)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
n AS (SELECT page_id, len(regexp_extract_all(h, '<h1\b')) AS h1, len(regexp_extract_all(h, '<li\b')) AS li, len(regexp_extract_all(h, '<a\s+href')) AS a FROM b)
SELECT page_id, 'heading' AS kind, 1 AS level, h1 AS n FROM n WHERE h1 > 0 UNION ALL SELECT page_id, 'item', 1, li FROM n WHERE li > 0 UNION ALL SELECT page_id, 'link', 0, a FROM n WHERE a > 0""",
    "link_disguised": "SELECT page_id, ['pаypal.com', 'bücher.example', 'bücher.example', 'books.example'][(page_id % 4 + 1)::INT] AS host, ['high', 'medium', 'medium', NULL][(page_id % 4 + 1)::INT] AS idn, ['pаypal.com', 'bücher.example', 'bücher.example', NULL][(page_id % 4 + 1)::INT] AS shows FROM pages",
    "html_texts": rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style|head)\b.*?</(script|style|head)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<(/?)(h1|li)\b[^>]*>', chr(1) || '\1\2' || chr(2), 'g'), '</?(p|div|article|nav|ul|ol|body|html|footer|header|main|section|br|table|tr)\b[^>]*>', chr(1) || chr(2), 'g'), '<[^>]*>', '', 'g') AS h FROM b),
p AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(1)), lambda x: [CASE WHEN x LIKE 'h1' || chr(2) || '%' THEN 'heading' WHEN x LIKE 'li' || chr(2) || '%' THEN 'item' ELSE 'paragraph' END,
      {_seen("string_split(x, chr(2))[-1]")}]), lambda x: x[2] <> '') AS l FROM t)
SELECT page_id, array_to_string(list_transform(l, lambda x: x[1] || ': ' || x[2]), chr(10)) AS lines FROM p WHERE len(l) > 0""",
    "html_headings": rf"WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS h FROM pages) SELECT page_id, {_seen("regexp_replace(h, '<[^>]*>', '', 'g')")} AS text FROM h",
    "html_anchors": r"SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS text FROM pages",
    "url_parts": rf"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '^[a-z]+://[^/:?#]*:([0-9]+)', 1), '') AS port FROM pages",
    "url_normal": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^www\.', ''), '/$', '') AS url FROM pages",
    "url_domains": f"WITH h AS (SELECT page_id, string_split('a.b.' || {_HOST} || CASE WHEN page_id % 3 = 0 THEN '.co.uk' ELSE '' END, '.') AS l FROM pages) SELECT page_id, array_to_string(list_slice(l, CASE WHEN page_id % 3 = 0 THEN -3 ELSE -2 END, -1), '.') AS domain FROM h",
    "url_in_text": "SELECT page_id, url AS value, 4 AS start, (4 + length(url))::INT AS stop FROM pages UNION ALL SELECT page_id, 'www.example.org/a', (10 + length(url))::INT, (27 + length(url))::INT FROM pages",
    "link_verdicts": f"WITH {_V} SELECT page_id, severity, array_to_string(rules, ',') AS rules, domain FROM d",
    "link_summary": f"WITH {_V} SELECT count(*) AS links, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(DISTINCT host) AS hosts FROM d",
    "link_rules": f"WITH {_V} SELECT rule, CASE WHEN rule IN ('brand', 'hidden', 'ip', 'shown', 'userinfo') THEN 'high' WHEN rule = 'cheap' THEN 'info' ELSE 'medium' END AS severity, count(*) AS n FROM (SELECT unnest(rules) AS rule FROM d) GROUP BY rule",
    "links_not_linked": "SELECT page_id, url FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 'www.example.org/b' FROM pages WHERE page_id % 2 = 1",
    "links_distinct": f"SELECT DISTINCT {_HOST} AS host FROM pages",
    "qr_payloads": r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'wifi' WHEN 1 THEN 'email' WHEN 2 THEN 'authenticator' WHEN 3 THEN 'payment' ELSE 'text' END AS kind,
CASE page_id % 5 WHEN 0 THEN 'network: Net' || page_id || ';x|security: WPA|with password' WHEN 1 THEN 'a' || page_id || '@b.c' WHEN 2 THEN 'Me ' || page_id WHEN 3 THEN 'to: Shop|account: DE' || page_id ELSE 'note ' || page_id END AS details,
CASE page_id % 5 WHEN 2 THEN 'high' WHEN 3 THEN 'high' ELSE 'info' END AS severity FROM pages""",
}
