"""Decoded files as tables: reachability, chains, outlines, signatures, forms, metadata before and after, catalogues."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.metadata import classify_key
from leafmill.operators.contains import containing


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, that of ``spark.checkpoint.dir``.

    Only a local master may do without: the executors of a cluster would not find a folder of the driver's own.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    given = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that the next round starts from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A table of at most so many nodes is broadcast; a larger one is joined by a shuffle.
FEW = 200_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many ``rows``, marked for broadcast if they are few."""
    return F.broadcast(df) if rows <= FEW else df


def _jumped(chain: DataFrame) -> DataFrame:
    """``file_id, node, up`` of chain nodes and their only predecessors: ``up`` becomes the nearest that is no chain node itself.

    Each round takes every pointer that still ends at a chain node twice as far, so a chain of n nodes needs log2(n) rounds. Rings of
    chain nodes have no such end and are left out.
    """
    open_, done = cut(chain), None
    left = open_.count()
    for _ in range(max(1, left).bit_length() + 1):
        further = open_.select(F.col("file_id").alias("_f"), F.col("node").alias("_n"), F.col("up").alias("_u"))
        ended = done.select(F.col("file_id").alias("_f"), F.col("node").alias("_n"), F.col("up").alias("_u")) if done is not None else None
        known = further.withColumn("_end", F.lit(False)) if ended is None else further.withColumn("_end", F.lit(False)).union(ended.withColumn("_end", F.lit(True)))
        step = open_.join(known, (F.col("file_id") == F.col("_f")) & (F.col("up") == F.col("_n")), "left")
        step = cut(step.select("file_id", "node", F.coalesce("_u", "up").alias("up"), (F.col("_n").isNull() | F.col("_end")).alias("_end")))
        ready = step.filter("_end").drop("_end")
        done = ready if done is None else cut(done.union(ready))
        open_ = step.filter("not _end").drop("_end")
        if not open_.limit(1).count():
            break
    return done


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows ``file_id, node`` of ``nodes`` that no path of ``edges`` (``file_id, src, dst``) leads to from ``roots``.

    Nodes with one edge in and one out form chains, which are contracted before the search: a chain is reached where the node that it
    begins at is. What is left is searched by a round for each step away from the roots; only nodes that are new go on
    to the next, and what has been seen is written together again from time to time.
    """
    key = ["file_id", "node"]
    begin = cut(roots.select(*key).distinct())
    links = cut(edges.select("file_id", "src", "dst").distinct())
    into = links.groupBy("file_id", F.col("dst").alias("node")).agg(F.count("*").alias("_in"), F.min("src").alias("up"))
    out = links.groupBy("file_id", F.col("src").alias("node")).agg(F.count("*").alias("_out"))
    inner = cut(into.filter("_in = 1").join(out.filter("_out = 1"), key).join(begin, key, "left_anti").select(*key, "up"))
    chain, short = None, links.select("file_id", F.col("src").alias("node"), "dst")
    if inner.limit(1).count():
        chain = _jumped(inner)
        # edges between the nodes that are left: those that come out of a chain come from its beginning
        ends = links.join(inner.select("file_id", F.col("node").alias("dst")), ["file_id", "dst"], "left_anti")
        ends = ends.join(chain.select("file_id", F.col("node").alias("src"), "up"), ["file_id", "src"], "left")
        short = cut(ends.select("file_id", F.coalesce("up", "src").alias("node"), "dst").distinct())
    seen, frontier, met, rounds = begin, begin, 0, 0
    # a few new nodes are sent to the edges: a round then is a pass over these, and no edge is shuffled
    while new := frontier.count():
        met, rounds = met + new, rounds + 1
        after = short.join(_few(frontier, new), key).select("file_id", F.col("dst").alias("node")).distinct()
        frontier = cut(after.join(_few(seen, met), key, "left_anti"))
        seen = seen.union(frontier)
        if rounds % 8 == 0:
            seen = cut(seen)
    if chain is None:
        return nodes.join(_few(seen, met), key, "left_anti")
    within = chain.join(seen.select("file_id", F.col("node").alias("up")), ["file_id", "up"], "left_semi").select(*key)
    return nodes.join(seen.union(within), key, "left_anti")


def issuer_chain(certs: DataFrame) -> DataFrame:
    """``file_id, leaf, depth, subject``: the issuers of every certificate ``file_id, subject, issuer``, nearest first, without going round.

    An issuer counts once, at its least depth, and a certificate is not its own issuer; so chains that go round end. Each round
    puts the known issuers of an issuer 1, 2, 4, … steps up behind it: a chain of n links takes log2(n) rounds.
    """
    first = certs.filter("issuer <> subject").select("file_id", F.col("subject").alias("leaf"), F.lit(1).alias("depth"), F.col("issuer").alias("subject"))
    known = cut(first.join(certs.select("file_id", "subject").distinct(), ["file_id", "subject"], "left_semi").select("file_id", "leaf", "depth", "subject").distinct())
    reach = 1
    while True:
        last = known.filter(F.col("depth") == reach).select("file_id", "leaf", F.col("subject").alias("_via"))
        if not last.limit(1).count():
            return known
        above = known.select("file_id", F.col("leaf").alias("_via"), (F.col("depth") + reach).alias("depth"), "subject")
        more = last.join(above, ["file_id", "_via"]).filter(F.col("subject") != F.col("leaf")).select("file_id", "leaf", "depth", "subject")
        known = cut(known.union(more).groupBy("file_id", "leaf", "subject").agg(F.min("depth").alias("depth")).select("file_id", "leaf", "depth", "subject"))
        reach *= 2


def display_name(subject):
    """The name to show of a distinguished name like ``CN=Jane Doe, O=Example``: the common name, else given and surname, organisation, e-mail, else all of it."""
    part = lambda key: F.nullif(F.trim(F.regexp_extract(subject, rf"(?:^|,)\s*{key}=([^,]*)", 1)), F.lit(""))
    person = F.nullif(F.concat_ws(" ", part("GN"), part("SN")), F.lit(""))
    return F.coalesce(part("CN"), person, part("O"), part("E"), F.nullif(F.trim(subject), F.lit("")), F.lit("Unnamed"))


def outline_tree(bookmarks: DataFrame) -> DataFrame:
    """``parent``: the sequence number of the last bookmark before that is one level up; ``valid``: no level is skipped.

    Every bookmark stands twice in the order: as a possible parent of the level below, and as one that looks for its own. So one window by level
    finds all parents, and no bookmark meets all earlier ones.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.coalesce(F.lag("level").over(w), F.lit(-1))
    roles = F.array(F.struct(F.col("level").alias("_at"), F.lit(1).alias("_asks")), F.struct((F.col("level") + 1).alias("_at"), F.lit(0).alias("_asks")))
    both = bookmarks.withColumn("_before", before).select("*", F.inline(roles))
    own = Window.partitionBy("doc_id", "_at").orderBy("seq", "_asks").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("parent", F.last(F.when(F.col("_asks") == 0, F.col("seq")), ignorenulls=True).over(own))
    before = F.col("_before")
    up = both.filter("_asks = 1").select(*bookmarks.columns, "_before", "parent")
    return up.withColumn("valid", (F.col("level") >= 0) & (F.col("level") <= before + 1)).drop("_before")


def changes_after(signatures: DataFrame) -> DataFrame:
    """What came after each signature (``file_id, field, end, file_length``): none, covered by a later one, or changed."""
    last = F.max("end").over(Window.partitionBy("file_id"))
    state = F.when(F.col("end") >= F.col("file_length"), "none").when(last >= F.col("file_length"), "covered").otherwise("changed")
    return signatures.withColumn("changes_after", state)


def signature_rollup(signatures: DataFrame) -> DataFrame:
    valid = F.col("signed_at").between(F.col("not_before"), F.col("not_after"))
    s = changes_after(signatures)
    return s.groupBy("file_id").agg(F.count("*").alias("signatures"), F.count_if("intact").alias("intact"), F.count_if(F.col("changes_after") == "changed").alias("changed"), F.count_if(valid).alias("valid_then"))


def apply_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Values by field name: read-only fields and choices that are not offered keep theirs, text is cut to its greatest length.

    Check boxes take ``value_b`` and lists ``value_l``, whose choices must all be offered, where both tables have these columns; an empty choice
    clears a field. A value of another kind than its field is passed over.
    """
    more = [c for c in ("value_b", "value_l") if c in fields.columns and c in values.columns]
    v = values.select(F.col("doc_id").alias("_d"), F.col("name").alias("_n"), F.col("value_s").alias("_v"), *[F.col(c).alias(f"_{c}") for c in more])
    offered = (F.size("options") == 0) | F.array_contains("options", F.col("_v")) | F.col("editable") | (F.col("_v") == "")
    open_ = ~F.col("read_only")
    takes_more = {
        "value_b": open_ & (F.col("kind") == "checkbox") & F.col("_value_b").isNotNull() if "value_b" in more else None,
        "value_l": open_ & (F.col("kind") == "list") & F.col("_value_l").isNotNull() & (F.size(F.array_except("_value_l", "options")) == 0) if "value_l" in more else None,
    }
    cut_value = F.when(F.col("max_length").isNotNull(), F.substring("_v", F.lit(1), F.col("max_length"))).otherwise(F.col("_v"))
    takes = F.col("_v").isNotNull() & ~F.col("read_only") & F.when(F.col("kind").isin("radio", "dropdown"), offered).otherwise(F.col("kind") == "text")
    new = {"value_s": F.when(takes, cut_value).otherwise(F.col("value_s"))} | {c: F.when(takes_more[c], F.col(f"_{c}")).otherwise(F.col(c)) for c in more}
    joined = fields.join(v, (F.col("doc_id") == F.col("_d")) & (F.col("name") == F.col("_n")), "left")
    return joined.withColumns(new).select(*fields.columns)


def classify_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("sensitivity", classify_key(F.col("key")))


def diff_before_after(entries: DataFrame) -> DataFrame:
    """``change`` of every entry ``file_id, stage, grp, key, value``: removed, left or new."""
    k = ["file_id", "grp", "key", "value"]
    both = entries.groupBy(*k).agg(F.count_if(F.col("stage") == "before").alias("b"), F.count_if(F.col("stage") == "after").alias("a"))
    return both.select(*k, F.when(F.col("a") == 0, "removed").when(F.col("b") == 0, "new").otherwise("left").alias("change"))


def resolve_targets(relationships: DataFrame, parts: DataFrame) -> DataFrame:
    """``path`` of each relationship's target, and whether such a part is there; null for external ones."""
    base = F.regexp_replace("rels", r"_rels/[^/]*\.rels$", "")
    whole = F.when(F.col("target").startswith("/"), F.substring(F.col("target"), F.lit(2), F.length("target"))).otherwise(F.concat(base, "target"))

    def step(acc, p):
        return F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p)))

    path = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    r = relationships.withColumn("path", F.when(~F.col("external"), path))
    have = parts.select(F.col("file_id").alias("_f"), F.col("path").alias("_p")).distinct()
    return r.join(have, (F.col("file_id") == F.col("_f")) & (F.col("path") == F.col("_p")), "left").withColumn("found", F.when(~F.col("external"), F.col("_p").isNotNull())).drop("_f", "_p")


def catalog_lookup(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """``shown``: the catalogue's text for ``key`` in ``lang``, or the key itself, with each ``{name}`` of ``params`` filled in."""
    c = catalog.select(F.col("lang").alias("_l"), F.col("key").alias("_k"), F.col("text").alias("_t"))
    df = texts.join(c, (F.col("lang") == F.col("_l")) & (F.col("key") == F.col("_k")), "left")
    filled = F.aggregate(F.map_entries("params"), F.coalesce("_t", "key"), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return df.withColumn("shown", filled).drop("_l", "_k", "_t")


def catalog_quality(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """By language: keys without text, texts without a key, keys given twice, and texts that lost or invented a ``{name}``."""
    names = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{(\w+)\}"), F.lit(1))))
    langs, wanted = catalog.select("lang").distinct(), keys.select("key").filter("key is not null").distinct()
    met = catalog.select("lang", "key").distinct().join(wanted, "key", "left_semi").groupBy("lang").agg(F.count("*").alias("_met"))
    missing = langs.join(met, "lang", "left").select("lang", (F.lit(wanted.count()) - F.coalesce("_met", F.lit(0))).alias("missing"))
    stale = catalog.join(keys, "key", "left_anti").groupBy("lang").agg(F.count("*").alias("stale"))
    twice = catalog.groupBy("lang", "key").count().filter("count > 1").groupBy("lang").agg(F.count("*").alias("twice"))
    off = catalog.filter(~names(F.col("key")).eqNullSafe(names(F.col("text")))).groupBy("lang").agg(F.count("*").alias("placeholders"))
    out = langs
    for part in (missing, stale, twice, off):
        out = out.join(part, "lang", "left")
    return out.fillna(0)


def keyword_rank(items: DataFrame, queries: DataFrame | str, k: int | None = 10, id_col: str = "id", name: str = "name", more: str = "text", keywords: str | None = None) -> DataFrame:
    """The ``k`` best items for a query (all of them where ``k`` is None) in which every one of its words is found, as ``id, score``.

    A word gives 6 where it begins a word of the name, 4 inside it, 3 where it begins a keyword (an array column) and 2 inside one, 1 elsewhere, the most
    of these; 4 more for the words in a row in the name, 4 for the id that reads the same with dashes, 2 for the words in order. A
    query without words finds all items, unscored (null). Many ``queries`` (``query``) at once give ``query, id, score``; each is looked up by its
    longest word in an index of the items' stretches of characters (``contains``). The limit is the feature: a top-k report.
    """
    single = isinstance(queries, str)
    typed = items.sparkSession.createDataFrame([(queries,)], "query string") if single else queries.select("query").distinct()
    q = typed.withColumn("_words", F.filter(F.split(F.lower(F.col("query")), r"\s+"), lambda w: w != ""))
    longest = F.array_max(F.transform("_words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = q.withColumn("_needle_", F.coalesce(longest, F.lit("")))
    low, rest = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(more, F.lit("")))
    terms = F.lower(F.array_join(F.coalesce(F.col(keywords), F.array().cast("array<string>")), " | ")) if keywords else F.lit("")
    df = items.select(id_col, low.alias("_name"), rest.alias("_rest"), terms.alias("_terms")).withColumns({"_parts": F.split("_name", r"[^\p{L}\p{N}]+"), "_keys": F.split("_terms", r"[^\p{L}\p{N}-]+")})

    def points(w):
        begins = lambda parts: F.exists(parts, lambda p: p.startswith(w))
        named = F.when(begins("_parts"), 6).when(F.contains("_name", w), 4)
        listed = F.when(begins("_keys"), 3).when(F.contains("_terms", w), 2)
        return F.coalesce(named, listed, F.when(F.contains("_rest", w), 1), F.lit(0))

    df = df.withColumn("_all", F.concat_ws("\n", "_name", "_terms", "_rest"))
    hit = containing(df, q, "_all", "_needle_").drop("_all", "_needle_").withColumn("_each", F.transform("_words", points)).filter(F.forall("_each", lambda p: p > 0))
    at = F.transform("_words", lambda w: F.position(w, F.col("_name")))
    found = F.forall("_words", lambda w: F.contains("_name", w))
    ordered = found & (F.size("_words") > 1) & F.forall(F.sequence(F.lit(1), F.greatest(F.size("_words") - 1, F.lit(1))), lambda i: F.coalesce(F.get(at, i) > F.get(at, i - 1), F.lit(False)))
    bonus = F.when(F.contains("_name", F.array_join("_words", " ")), 4).otherwise(0) + F.when(F.contains(F.lower(F.col(id_col).cast("string")), F.array_join("_words", "-")), 4).otherwise(0) + F.when(ordered, 2).otherwise(0)
    total = F.aggregate("_each", F.lit(0), lambda x, y: x + y) + bonus
    scored = hit.select("query", id_col, F.when(F.size("_words") > 0, total).cast("long").alias("score"))
    if single:
        out = scored.drop("query").orderBy(F.desc("score"), id_col)
        return out if k is None else out.limit(k)
    if k is None:
        return scored
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), id_col))
    return scored.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


# The plural categories that a language needs.
CATEGORIES = {"en": ["one", "other"], "de": ["one", "other"], "es": ["one", "many", "other"], "fr": ["one", "many", "other"], "ar": ["zero", "one", "two", "few", "many", "other"]}


def plural_gaps(catalog: DataFrame) -> DataFrame:
    """``lang, key, missing``: plural texts (``forms``, a map by category) that lack a category of their language; other languages need ``other`` alone."""
    need = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in CATEGORIES.items() for x in pair])
    wanted = F.coalesce(F.try_element_at(need, F.col("lang")), F.array(F.lit("other")))
    missing = F.array_except(wanted, F.map_keys("forms"))
    return catalog.filter("forms is not null").select("lang", "key", missing.alias("missing")).filter("size(missing) > 0")


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """The value, rounded to halves, with the most weight in each group; of equal ones that met first."""
    half = F.floor(F.col(value) * 2 + 0.5) / 2
    per = rows.groupBy(*keys, half.alias("mode")).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    return per.groupBy(*keys).agg(F.max_by("mode", F.struct(F.col("w"), -F.col("first"))).alias("mode"))


def page_text(words: DataFrame) -> DataFrame:
    """``doc, page, text, words, confidence`` of OCR words ``doc, page, par, line, word, text, confidence``: lines and, with a blank line
    between them, paragraphs."""
    keys = ["doc", "page"]
    ordered = lambda at, c: F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda s: s[c])
    lines = words.groupBy(*keys, "par", "line").agg(F.array_join(ordered("word", "text"), " ").alias("text"), F.count("*").alias("n"), F.sum("confidence").alias("c"))
    pars = lines.groupBy(*keys, "par").agg(F.array_join(ordered("line", "text"), "\n").alias("text"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    return pars.groupBy(*keys).agg(F.array_join(ordered("par", "text"), "\n\n").alias("text"), F.sum("n").alias("words"), F.floor(F.sum("c") / F.sum("n") + 0.5).cast("long").alias("confidence"))


def sheet_extent(cells: DataFrame) -> DataFrame:
    """Used rows and columns of each sheet of cells ``sheet, row, col, value``, blank ones apart; ``hidden`` where the cells say so of their sheets."""
    hidden = [F.bool_or(F.coalesce("hidden", F.lit(False))).alias("hidden")] if "hidden" in cells.columns else []
    return cells.filter(F.trim("value") != "").groupBy("sheet").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count("*").alias("filled"), *hidden)


# A value's place in a template, and what may stand for a number.
PLACE, NUMBER = r"\{(\d+|#)\}", r"(\d[\d,.\x{a0}\x{202f}]*)"


def template_match(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """``text, shown``: texts made from a template with values (``{0}``, ``{1}``, …, ``{#}`` for a number), rebuilt in its ``translation``, which may
    name the values in another order. The longest template counts, of equal ones the greater. Templates without a value match nothing.

    A text is tried only on templates whose longest literal part it holds (``contains``).
    """
    parts, names = F.split("template", PLACE, -1), F.regexp_extract_all("template", F.lit(PLACE), F.lit(1))
    quoted = lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    value = lambda name: F.when(name == "#", F.lit(NUMBER)).when(name.isNotNull(), F.lit(r"([\s\S]*?)")).otherwise(F.lit(""))
    pattern = F.concat(F.lit("^"), F.array_join(F.zip_with(F.transform(parts, quoted), F.transform(names, value), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), ""), F.lit("\\z"))
    literal = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    t = templates.filter(F.col("template").rlike(PLACE)).select("template", "translation", names.alias("_names"), pattern.alias("_pattern"), literal.alias("_literal")).distinct()
    d = texts.select("text").distinct()
    hit = containing(d, t, "text", "_literal").filter(F.call_function("rlike", F.col("text"), F.col("_pattern")))
    best = hit.groupBy("text").agg(F.max_by(F.struct("translation", "_names", "_pattern"), F.struct(F.length("template"), "template")).alias("_b"))
    values = F.transform("_b._names", lambda name, k: F.struct(name.alias("name"), F.call_function("regexp_extract", F.col("text"), F.col("_b._pattern"), k + 1).alias("value")))
    own = lambda name: F.coalesce(F.try_element_at(F.filter("_values", lambda v: v["name"] == name), F.lit(-1))["value"], F.concat(F.lit("{"), name, F.lit("}")))
    placed = F.transform(F.regexp_extract_all("_b.translation", F.lit(PLACE), F.lit(1)), own)
    shown = F.array_join(F.zip_with(F.split("_b.translation", PLACE, -1), placed, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    best = best.withColumn("_values", values).select(F.col("text").alias("_k"), shown.alias("_shown"))
    return d.join(best, F.col("text") == F.col("_k"), "left").select("text", F.coalesce("_shown", "text").alias("shown"))


def forensic_findings(entries: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``file_id, id, severity, detail`` of image metadata ``file_id, key, value``: made with AI, edited, software, changed over a minute after it
    was taken, camera, no camera, extra pictures; with ``facts`` (``file_id, c2pa, ai, quality, latitude, longitude``, any of them null) also
    Content Credentials, the quality of a JPEG, and where it was taken. A file with facts alone has findings too."""
    from leafmill.functions.metadata import editor_flags, parse_exif_date

    k = F.lower("key")
    flag = editor_flags(F.col("key"), F.col("value"))
    date = lambda *names: F.min(F.when(k.isin(list(names)), parse_exif_date(F.col("value"))))
    shown = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("value")))), ", ")
    g = entries.groupBy("file_id").agg(
        F.max(flag == "ai").alias("_ai"), F.max((flag == "editor") | F.col("key").rlike("History")).alias("edited"), F.max(flag == "software").alias("software"),
        date("datetimeoriginal", "createdate", "photoshop:datecreated", "xmp:createdate").alias("taken"), date("modifydate", "datetime", "xmp:modifydate", "xmp:metadatadate").alias("changed"),
        F.max(k.isin("make", "model")).alias("camera"), F.max(k.isin("trailer", "mpf")).alias("extra"),
        shown(flag == "editor").alias("editors"), shown(flag == "software").alias("programs"), shown(k == "make").alias("make"), shown(k == "model").alias("model"),
    )
    if facts is None:
        g = g.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("c2pa", "boolean"), ("ai", "boolean"), ("quality", "int"), ("latitude", "double"), ("longitude", "double"))])
    else:
        g = g.join(facts.select("file_id", "c2pa", "ai", "quality", "latitude", "longitude"), "file_id", "full")
    yes = lambda c: F.coalesce(c, F.lit(False))
    ai, edited, camera = yes(F.col("_ai")) | yes(F.col("ai")), yes(F.col("edited")), yes(F.col("camera"))
    gap = F.unix_timestamp("changed") - F.unix_timestamp("taken")
    named = F.when(F.startswith(F.lower("model"), F.lower("make")), F.col("model")).otherwise(F.trim(F.concat_ws(" ", "make", "model")))
    none = F.lit(None).cast("string")
    rules = [
        (ai, "ai", "high", none), (yes(F.col("c2pa")), "c2pa", "info", none), (edited, "edited", "medium", F.nullif(F.col("editors"), F.lit(""))), (~edited & yes(F.col("software")), "software", "info", F.col("programs")),
        (yes(gap > 60), "dates", "medium", duration_text(gap)), (camera, "camera", "info", named), (~camera & ~ai, "no-camera", "info", none), (F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "location", "medium", F.format_string("%.5f, %.5f", "latitude", "longitude")),
        (yes(F.col("extra")), "extra-images", "medium", none), (F.col("quality").isNotNull(), "quality", "info", F.col("quality").cast("string")),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), d.alias("detail"))) for c, i, s, d in rules]))
    return g.select("file_id", F.inline(hits))


def duration_text(seconds):
    """Seconds as minutes, hours, days or years, the first in which they are few."""
    half = lambda x: F.floor(x + 0.5).cast("long")
    minutes = half(seconds / 60)
    hours = half(minutes / 60)
    days = half(hours / 24)
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
    return F.when(minutes < 60, unit(minutes, "minute")).when(hours < 48, unit(hours, "hour")).when(days < 365, unit(days, "day")).otherwise(unit(half(days / 365), "year"))
