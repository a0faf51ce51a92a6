"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import ann, covertree, decontaminate, langid, mixing, neardup, packing, quality, runs, suffixdedup, toxicity, warc, wordpiece
from leafmill.llm.common import fold, table, word_count, words_column


def _scored(df: DataFrame, held_out) -> DataFrame:
    return df.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.read_matrices(packing.write_matrices(packing.pack_documents(table(spark, sf_dir, "documents"))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(toxicity.score(docs, weights), held_out)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "shared", "containment")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = mixing.quality_weight(docs, table(spark, sf_dir, "labels"))
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _scored(quality.score(docs, weights), held_out)


def _periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where of one id in ten, by its crc32, the words from one of them on are made to repeat the next few."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, w = F.floor(h / 10), words_column(F.col("text"), lower=False)
    n = F.greatest(F.size(w), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.when(h % 10 == 0, F.concat_ws(" ", F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(_periodic(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    start, length, period = -F.col("r.start"), F.col("r.length"), -F.col("r.period")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return out.withColumn("r", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * r.length) div -r.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_nearest": op2_nearest,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language": op13_language,
}

#: crc32 of the decimal text of doc_id in SQL, bit by bit; of no id 0.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
_CRC32 = f"CASE WHEN doc_id IS NULL THEN 0 ELSE {_CRC32} END::BIGINT"

SQL = {
    "op2_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, min(list_distance(q.v, c.v)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10
""",
    "op6_decontamination": """
WITH t AS (SELECT DISTINCT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 1, item_id, text FROM benchmark),
w AS (SELECT row_number() OVER () AS k, kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
v AS (SELECT DISTINCT least(len(w), 5) AS width FROM w WHERE kind = 1 AND len(w) > 0),
s AS (SELECT kind, k, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' ')))) AS x
      FROM w JOIN v ON len(w) >= width AND (kind = 0 OR width = least(len(w), 5))),
q AS (SELECT k, count(*)::BIGINT AS q FROM s WHERE kind = 1 GROUP BY k),
h AS (SELECT d.k AS d, i.k AS i, count(*)::BIGINT AS shared FROM s d JOIN s i ON d.x = i.x AND d.width = i.width AND d.kind = 0 AND i.kind = 1 GROUP BY ALL)
SELECT d.id AS doc_id, i.id AS item_id, q AS item_shingles, shared, shared / q AS containment
FROM h JOIN q ON q.k = h.i JOIN w d ON d.k = h.d JOIN w i ON i.k = h.i WHERE shared >= 0.8 * q
""",
    "op7_mixing": """
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN q.q >= 1 THEN 2.0 WHEN q.q < 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, cap <= w * level AS capped FROM l),
f AS (SELECT level AS first FROM c WHERE NOT capped ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, w * (SELECT first FROM f)) END::DOUBLE AS target FROM c),
k AS (SELECT d.doc_id, size, source_size, target, floor(target / source_size) AS epochs, target - floor(target / source_size) * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY -ln(u) / weight, d.doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (epochs + CASE WHEN before < rest AND before + size / 2 <= rest THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM k
""",
    "op8_near_duplicates": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS v, a AS l FROM u UNION SELECT u.b, r.l FROM r JOIN u ON u.a = r.v),
c AS (SELECT v, min(l) AS l FROM r GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.l, n.doc_id) AS component_id, n.doc_id = coalesce(c.l, n.doc_id) AS kept
FROM n LEFT JOIN c ON c.v = n.doc_id
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
         ('0x' || substr(d.hex || '00', 1 + (i * 5) // 4, 2))::INT >> (3 - (i * 5) % 4)) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d JOIN f ON d.hex = f.hex
""",
    "op11_periodic_runs": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_CRC32} AS h,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS o FROM documents),
a AS (SELECT *, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) ELSE len(o) END AS a FROM d),
e AS (SELECT row, doc_id, list_transform(range(0, n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) AS w FROM a),
x AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM e),
m AS (SELECT x.row, x.i, x.i - y.i AS q FROM x JOIN x y ON x.row = y.row AND x.word = y.word AND y.i < x.i),
k AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS stretch FROM m),
s AS (SELECT row, q, min(i) - q AS start, count(*) + q AS length FROM k GROUP BY row, q, stretch HAVING count(*) >= q AND count(*) + q >= 12),
r AS (SELECT row, start, length, min(q) AS period FROM s GROUP BY row, start, length),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY row ORDER BY length DESC, start, period) = 1),
t AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY row),
g AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT x.row, string_agg(word, ' ' ORDER BY x.i) AS rest FROM x ANTI JOIN g ON x.row = g.row AND x.i = g.i GROUP BY x.row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM e LEFT JOIN l USING (row) LEFT JOIN t USING (row) LEFT JOIN c USING (row)
""",
    "op12_hard_negatives": """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
    "op13_language": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text, lang, {_CRC32} % 5 = 0 AS held_out FROM documents),
w AS (SELECT row, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM d),
c AS (SELECT row, ' ' || w || ' ' AS w, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT row, substr(w, i, k) AS g, sum(n) AS n FROM c, LATERAL (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT unnest(range(1, length(w) - k + 2)) AS i)
      WHERE substr(w, i, k) <> ' ' GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS r
      FROM (SELECT lang, g, sum(n) AS n FROM g JOIN d USING (row) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY r < 300),
t AS (SELECT row, g, rank() OVER (PARTITION BY row ORDER BY n DESC) - 1 AS r FROM g QUALIFY row_number() OVER (PARTITION BY row ORDER BY n DESC, g) <= 300),
s AS (SELECT t.row, l.lang, sum(CASE WHEN p.r IS NULL THEN 300 ELSE abs(p.r - t.r) END) AS off, count(*) AS k
      FROM t CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = t.g GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY row ORDER BY off, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - off::DOUBLE / (300 * k), 0)::DOUBLE AS score FROM d LEFT JOIN b USING (row)
""",
}
