"""SQL names for column functions that are single built-in expressions, as temporary SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leafmill.functions import pii


def _quoted(pattern: str) -> str:
    """A regular expression as a SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(t, {_quoted(pattern)}, {group})"


#: name, parameters, type, expression; patterns are those of the column functions.
FUNCTIONS = [
    ("lm_normal_url", "u STRING", "STRING", "regexp_replace(regexp_replace(regexp_replace(lower(trim(u)), '^[a-z]+://', ''), '^www[.]', ''), '/$', '')"),
    ("lm_has_words", "t STRING", "BOOLEAN", f"t rlike {_quoted(r'[\p{L}]{2}')}"),
    ("lm_count_words", "t STRING", "INT", f"regexp_count(t, {_quoted(r'[\p{L}\p{N}]+')})"),
    ("lm_clean_hash", "t STRING", "STRING", "CASE WHEN regexp_replace(lower(trim(t)), '[ :-]', '') rlike '^[0-9a-f]+$' THEN regexp_replace(lower(trim(t)), '[ :-]', '') END"),
    ("lm_emails", "t STRING", "ARRAY<STRING>", _all(pii.EMAIL)),
    ("lm_ibans", "t STRING", "ARRAY<STRING>", _all(pii.IBAN)),
    ("lm_ssns", "t STRING", "ARRAY<STRING>", _all(pii.SSN)),
    ("lm_ninos", "t STRING", "ARRAY<STRING>", _all(pii.NINO)),
    ("lm_births", "t STRING", "ARRAY<STRING>", _all(pii.DOB, 1)),
    ("lm_ips", "t STRING", "ARRAY<STRING>", _all(pii.IP)),
    ("lm_cards", "t STRING", "ARRAY<STRING>", f"filter({_all(pii.CARD)}, v -> luhn_check(regexp_replace(v, '[^0-9]', '')))"),
    ("lm_hex_hashes", "t STRING", "STRUCT<sha256: STRING, sha1: STRING, md5: STRING>", "named_struct('sha256', sha2(t, 256), 'sha1', sha1(t), 'md5', md5(t))"),
    ("lm_with_suffix", "name STRING, suffix STRING", "STRING", f"regexp_replace(name, {_quoted(r'^(.+?)(\.[^.]*)?$')}, concat('$1-', suffix, '$2'))"),
    ("lm_camera_exposure", "v DOUBLE", "STRING", "CASE WHEN v > 0 AND v < 1 THEN concat('1/', cast(floor(1 / v + 0.5) AS STRING), ' s') END"),
    ("lm_permission_flags", "p BIGINT", "ARRAY<STRING>", "array_compact(array(if(p & 4 = 0, 'printing', NULL), if(p & 8 = 0, 'editing', NULL), if(p & 16 = 0, 'copying', NULL), if(p & 32 = 0, 'commenting', NULL)))"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql`` and returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
