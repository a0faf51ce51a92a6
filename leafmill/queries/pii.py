"""Personal data in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import pii
from leafmill.functions.spans import SPACE, regex_spans
from leafmill.operators import findings as ops
from leafmill.sources.tables import read_table


def _docs(spark, sf_dir, *more):
    return read_table(spark, sf_dir, "documents", "doc_id", "text", *more)


def _kind(kind):
    def run(spark, sf_dir):
        found = _docs(spark, sf_dir).select("doc_id", F.explode(pii.spans_of(kind, F.col("text"))).alias("s"))
        return found.select("doc_id", "s.value", "s.start", "s.stop")

    return run


def pii_findings(spark, sf_dir):
    return ops.pii_findings(_docs(spark, sf_dir))


#: What is planted after every text: a value of four kinds, and three that only look like one. (kind, value, place)
PLANTED = "\nGB82 WEST 1234 5698 7654 32; 123-45-6789; AB 12 34 56 C; born on 12/05/1980; GB82 WEST 1234 5698 7654 33; 000-12-3456; BG123456A"
FOUND = [("iban", "GB82 WEST 1234 5698 7654 32", 1), ("ssn", "123-45-6789", 30), ("nino", "AB 12 34 56 C", 43), ("dob", "12/05/1980", 66)]


def pii_planted(spark, sf_dir):
    """Kinds that the tables do not hold by themselves, planted after every text."""
    docs = _docs(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(PLANTED)))
    return ops.pii_findings(docs, ["iban", "ssn", "nino", "dob"]).select("doc_id", "kind", "value", F.col("start").cast("long").alias("start"))


def pii_summary(spark, sf_dir):
    return ops.pii_summary(ops.pii_findings(_docs(spark, sf_dir, "lang"), keep=("lang",)), ["lang"])


def pii_by_kind(spark, sf_dir):
    return ops.pii_summary(ops.pii_findings(_docs(spark, sf_dir)))


def pii_filter_kinds(spark, sf_dir):
    return ops.filter_kinds(ops.pii_findings(_docs(spark, sf_dir)), ["email", "ip"]).select("doc_id", "kind", "value", "start")


def redacted(spark, sf_dir):
    out = ops.redact(_docs(spark, sf_dir), ["email", "ip"], "#")
    return out.select("doc_id", F.sha2(F.col("text"), 256).alias("sha"), F.length("text").cast("long").alias("n"))


def redaction_leaves_nothing(spark, sf_dir):
    """What is found again in the masked corpus: no rows but the total."""
    again = ops.pii_findings(ops.redact(_docs(spark, sf_dir)))
    return again.agg(F.count("*").alias("left_over")).join(_docs(spark, sf_dir).agg(F.count("*").alias("documents")))


def word_spans(spark, sf_dir):
    """Positions of numbers in every text."""
    found = _docs(spark, sf_dir).select("doc_id", F.explode(regex_spans(F.col("text"), "[0-9]+")).alias("s"))
    return found.select("doc_id", "s.value", "s.start", "s.stop")


def findings_by_file(spark, sf_dir):
    """Severity of each document: cards and bank accounts high, the rest medium."""
    found = ops.pii_findings(_docs(spark, sf_dir))
    severity = F.when(F.col("kind").isin("card", "iban", "ssn"), "high").otherwise("medium")
    verdict = ops.file_verdict(found.select("doc_id", F.col("kind").alias("id"), severity.alias("severity")), "doc_id")
    return verdict.select("doc_id", "severity", F.array_join("ids", ",").alias("ids"))


def findings_ordered(spark, sf_dir):
    found = findings_by_file(spark, sf_dir)
    return ops.order_findings(found, "doc_id")


def finding_items(spark, sf_dir):
    """The first 40 distinct values of each kind."""
    return ops.sample_items(ops.pii_findings(_docs(spark, sf_dir)), ["kind"], "value").select("kind", "total", F.array_join("items", "|").alias("items"))


def search_hits(spark, sf_dir):
    return ops.search_text(_docs(spark, sf_dir), "of  the")


def report_lines(spark, sf_dir):
    return ops.findings_report(ops.pii_findings(_docs(spark, sf_dir)))


QUERIES = {
    "pii_planted": pii_planted,
    "pii_email": _kind("email"),
    "pii_card": _kind("card"),
    "pii_ip": _kind("ip"),
    "pii_phone": _kind("phone"),
    "pii_iban": _kind("iban"),
    "pii_ssn": _kind("ssn"),
    "pii_nino": _kind("nino"),
    "pii_dob": _kind("dob"),
    "pii_findings": pii_findings,
    "pii_summary": pii_summary,
    "pii_by_kind": pii_by_kind,
    "pii_filter_kinds": pii_filter_kinds,
    "redacted": redacted,
    "redaction_leaves_nothing": redaction_leaves_nothing,
    "number_spans": word_spans,
    "findings_by_file": findings_by_file,
    "findings_ordered": findings_ordered,
    "finding_items": finding_items,
    "search_hits": search_hits,
    "report_lines": report_lines,
}


def spans_sql(pattern: str, name: str, where: str = "true", value: str = "value", text: str = "text", holds: str = "true") -> str:
    """SQL for matches with positions. RE2 has no look-around, so ``text`` may be the text with ``MARKS`` that tell where a match may begin or end;
    positions and values are those without them. ``value`` is what is kept of a match, null if nothing is; ``holds`` is true of every text with a match."""
    return f"""{name}_t AS (SELECT doc_id, text, {text} AS t FROM documents WHERE {holds}),
{name}_m AS (SELECT doc_id, text, list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: {bare("x")}) AS m, list_transform(string_split_regex(t, '{pattern}'), lambda x: {bare("x")}) AS p FROM {name}_t),
{name}_s AS (SELECT doc_id, text, m[i] AS value, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start
  FROM {name}_m, unnest(range(1, len(m) + 1)) t(i)),
{name} AS (SELECT doc_id, text, value, start, (start + length(value))::INT AS stop FROM (SELECT doc_id, text, {value} AS value, start FROM {name}_s) WHERE value IS NOT NULL AND {where})"""


#: Characters that stand in no pattern: what a text holds of them counts as other marks.
MARKS = r"[\x01\x03\x04]"


def bare(text: str) -> str:
    return f"regexp_replace({text}, '{MARKS}', '', 'g')"


def run_marked(chars: str, text: str = "text") -> str:
    """The text with marks around every longest run of ``chars``: \x01 before and \x04 after."""
    return f"regexp_replace(regexp_replace({text}, '{MARKS}', '!', 'g'), '([{chars}]+)', chr(1) || '\\1' || chr(4), 'g')"


#: White space as in ``SPACE``: RE2's \s lacks the vertical tab and all beyond ASCII.
WHITE = rf"\x0b{SPACE}"
_D = "regexp_replace(x, '[^0-9]', '', 'g')"
#: Of a match, the longest part from its start that ends before a space or with it and is a card's number.
CARD_VALUE = f"""list_filter(list_transform(range(len(string_split(value, ' ')), 0, -1), lambda n: array_to_string(string_split(value, ' ')[1:n], ' ')), lambda x: length({_D}) BETWEEN 13 AND 19 AND regexp_matches(x, '^[2-6]')
  AND replace({_D}, {_D}[1], '') <> '' AND list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_D})[i]::INT ELSE (reverse({_D})[i]::INT * 2) // 10 + (reverse({_D})[i]::INT * 2) % 10 END)) % 10 = 0)[1]"""
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = spans_sql(r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}", "email")
_CARD = spans_sql(r"\x01(?:[0-9](?:-|\x04 \x01)?){12,18}[0-9]\x04", "card", value=CARD_VALUE, text=run_marked("0-9-"))
_IP = spans_sql(rf"\x01(?:{OCTET}\.){{3}}{OCTET}\x04", "ip", r"NOT regexp_matches(value, '^[0-2]\.[0-9]\.[0-9]\.[0-9]$')", text=run_marked("0-9."))
_DIGITS = "length(regexp_replace(value, '[^0-9]', '', 'g'))"
# \x01 stands before a run of \w and +, \x04 after one of \w, \x03 before a bracket that follows neither
_FREE = r"regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x01\x03\x04]', '!', 'g'), '([\w+]+)', chr(1) || '\1', 'g'), '(\w+)', '\1' || chr(4), 'g'), '(', chr(3) || '('), '([\x04+])\x03', '\1', 'g')"
_PHONE = spans_sql(
    rf"[\x01\x03](?:\+|00)?\x04?\(?\x01?[0-9](?:{MARKS}*[0-9{WHITE}().-]){{6,18}}{MARKS}*[0-9]\x04",
    "phone",
    f"{_DIGITS} BETWEEN 8 AND 15 AND NOT regexp_matches(value, '^[0-9]{{1,4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,4}}$') AND NOT (regexp_matches(value, '^[0-9]+$') AND NOT regexp_matches(value, '^0[0-9]{{9,10}}$'))"
    rf" AND NOT regexp_matches(value, '^[0-9]+\.[0-9]+$') AND (regexp_matches(value, '^(?:\+|00|\(|0)') OR regexp_matches(value, '[0-9]{{3}}[{WHITE}.-][0-9]{{3}}[{WHITE}.-][0-9]{{4}}'))",
    text=_FREE,
    holds=f"regexp_matches(text, '[0-9][0-9{WHITE}().-]{{6,18}}[0-9]')",
)
_ALL = f"""{_EMAIL}, {_CARD}, {_IP}, {_PHONE},
c AS (SELECT * FROM card WHERE NOT EXISTS (SELECT 1 FROM email e WHERE e.doc_id = card.doc_id AND card.start < e.stop AND card.stop > e.start)),
i AS (SELECT * FROM ip WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM email UNION ALL SELECT * FROM c) e WHERE e.doc_id = ip.doc_id AND ip.start < e.stop AND ip.stop > e.start)),
h AS (SELECT * FROM phone WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM email UNION ALL SELECT * FROM c UNION ALL SELECT * FROM i) e WHERE e.doc_id = phone.doc_id AND phone.start < e.stop AND phone.stop > e.start)),
f AS (SELECT 'email' AS kind, * FROM email UNION ALL SELECT 'card', * FROM c UNION ALL SELECT 'ip', * FROM i UNION ALL SELECT 'phone', * FROM h)"""
_CONTEXT = rf"""regexp_replace(concat(CASE WHEN start > 32 THEN '…' ELSE '' END, substr(text, greatest(start - 32, 0) + 1, least(start, 32)), '[[', substr(text, start + 1, stop - start), ']]',
  substr(text, stop + 1, 32), CASE WHEN stop + 32 < length(text) THEN '…' ELSE '' END), '[{WHITE}]+', ' ', 'g')"""
_NONE = "SELECT doc_id, text AS value, 0 AS start, 0 AS stop FROM documents WHERE regexp_matches(text, '{}')"
_VERDICT = "SELECT doc_id, CASE WHEN bool_or(kind IN ('card', 'iban', 'ssn')) THEN 'high' ELSE 'medium' END AS severity, array_to_string(list_sort(list_distinct(list(kind))), ',') AS ids FROM f GROUP BY doc_id"
SQL = {
    "pii_planted": "SELECT doc_id, kind, value, (length(coalesce(text, '')) + place)::BIGINT AS start FROM documents, (VALUES " + ", ".join(f"('{k}', '{v}', {at})" for k, v, at in FOUND) + ") p(kind, value, place)",
    "pii_email": f"WITH {_EMAIL} SELECT doc_id, value, start, stop FROM email",
    "pii_card": f"WITH {_CARD} SELECT doc_id, value, start, stop FROM card",
    "pii_ip": f"WITH {_IP} SELECT doc_id, value, start, stop FROM ip",
    "pii_phone": f"WITH {_PHONE} SELECT doc_id, value, start, stop FROM phone",
    # RE2 cannot express these; their pattern without the exclusions already finds nothing in these tables
    "pii_iban": _NONE.format(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"),
    "pii_ssn": _NONE.format(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    "pii_nino": _NONE.format(r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b"),
    "pii_dob": _NONE.format("(?i)(date of birth|birth ?date|geburtsdatum|date de naissance|fecha de nacimiento|data di nascita)"),
    "pii_findings": f"WITH {_ALL} SELECT doc_id, kind, value, start, stop, {_CONTEXT} AS context FROM f",
    "pii_summary": f"WITH {_ALL} SELECT lang, kind, count(*) AS findings, count(DISTINCT f.doc_id) AS documents FROM f JOIN (SELECT DISTINCT doc_id, lang FROM documents) d ON d.doc_id = f.doc_id GROUP BY ROLLUP (lang, kind)",
    "pii_by_kind": f"WITH {_ALL} SELECT kind, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM f GROUP BY kind",
    "pii_filter_kinds": f"WITH {_ALL} SELECT doc_id, kind, value, start FROM f WHERE kind IN ('email', 'ip')",
    # what is masked is what is found of the two kinds alone: a card has no say
    "redacted": f"""WITH {_EMAIL}, {_IP}, s AS (SELECT doc_id, start, stop FROM email UNION ALL SELECT doc_id, start, stop FROM ip WHERE NOT EXISTS (SELECT 1 FROM email e WHERE e.doc_id = ip.doc_id AND ip.start < e.stop AND ip.stop > e.start)),
l AS (SELECT doc_id, list(start ORDER BY start) AS b, list(stop ORDER BY start) AS e FROM s GROUP BY doc_id),
r AS (SELECT d.doc_id, CASE WHEN b IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(b) + 2), lambda i: substr(text, coalesce(e[i - 1], 0) + 1, coalesce(b[i], length(text)) - coalesce(e[i - 1], 0))), '#') END AS text FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT doc_id, sha256(text) AS sha, length(text)::BIGINT AS n FROM r""",
    "redaction_leaves_nothing": "SELECT 0::BIGINT AS left_over, count(*) AS documents FROM documents",
    "number_spans": f"WITH {spans_sql('[0-9]+', 'n')} SELECT doc_id, value, start, stop FROM n",
    "findings_by_file": f"WITH {_ALL} {_VERDICT}",
    "findings_ordered": f"WITH {_ALL}, v AS ({_VERDICT}) SELECT * FROM v ORDER BY severity <> 'high', doc_id",
    "finding_items": f"WITH {_ALL}, d AS (SELECT DISTINCT kind, value FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value) AS n FROM d) SELECT kind, count(*) AS total, string_agg(CASE WHEN n <= 40 THEN CASE WHEN length(value) > 120 THEN substr(value, 1, 120) || '…' ELSE value END END, '|' ORDER BY n) AS items FROM r GROUP BY kind",
    "search_hits": r"WITH t AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, ((length(t) - length(replace(t, 'of the', ''))) // 6)::BIGINT AS hits FROM t WHERE contains(t, 'of the')",
    "report_lines": f"WITH {_ALL} SELECT concat_ws(chr(9), kind, regexp_replace(value, '[\\t\\r\\n]+', ' ', 'g'), start::VARCHAR) AS line FROM f",
}
