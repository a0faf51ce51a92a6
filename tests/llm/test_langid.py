from collections import Counter

from pyspark.sql import functions as F

from leafmill.llm import langid
from leafmill.llm.common import fold, table
from leafmill.llm.queries import QUERIES


def plain_counts(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        padded = f" {word} "
        for n in range(1, langid.GRAM + 1):
            out.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " " and word)
    return out


def plain_language(text, profiles):
    own = sorted(plain_counts(text).items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]
    if not own or not profiles:
        return "und", 0.0
    rank = {g: sum(m > n for _, m in own) for g, n in own}
    far = {lang: sum(abs(r - p[g]) if g in p else langid.PROFILE for g, r in rank.items()) for lang, p in profiles.items()}
    best = min(far, key=lambda x: (far[x], x))
    return best, 1 - far[best] / (langid.PROFILE * len(own))


def text_of(gram):
    return "".join(chr(c) for c in (gram >> 42 & 0x1FFFFF, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if c)


ODD = ["", " ", "a", "A b", "é1b²c_d", "漢字かな abc", "𝒳y z", "ab" * 40, "İstanbul ΣΑΣ", None, "12 34 ²!", "x\n\ny"]


def test_counts_equal_plain_ones_in_parts_of_any_length(monkeypatch):
    for held in (1, 2, 3, 5, 1 << 20):
        monkeypatch.setattr(langid, "HELD_CHARACTERS", held)
        for text in ODD:
            grams, n = langid.gram_counts(text)
            assert dict(zip(map(text_of, grams.tolist()), n.tolist())) == plain_counts(text)
            assert [text_of(g) for g in grams.tolist()] == sorted(plain_counts(text))


def test_operator_equals_plain_version(spark):
    texts = [("de", "der die das und nicht straße"), ("fr", "le la les où et été"), ("en", "the and of to in is it"), ("en", "this that with from"), ("xx", "123 ..."), (None, "zzz yyy"), ("fr", None)]
    docs = spark.createDataFrame([(k, lang, text, 1) for k, (lang, text) in enumerate(texts * 3)] + [(None, "zz", "qqq", 1), (None, "zz", "qqq", 1)], "doc_id long, lang string, text string, SCORE int")
    learn = F.col("doc_id").isNotNull()
    profiles = langid.fit(docs, learn)
    assert profiles.languages == ["de", "en", "fr"]  # one without letters, without language, or only in rows not learnt from: not learnt
    plain = {}
    for lang in profiles.languages:
        total = sum((plain_counts(t) for own, t in texts * 3 if own == lang), Counter())
        plain[lang] = {g: r for r, (g, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE])}
    asked = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD + [t for _, t in texts] + ["the the the " * 50_000])], "doc_id long, text string, Lang_Pred string")
    out = langid.identify(asked, profiles)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == asked.count()
    for r in rows:
        assert (r["lang_pred"], round(r["score"], 12)) == tuple(x if isinstance(x, str) else round(x, 12) for x in plain_language(r["text"], plain))
    assert langid.identify(docs.limit(0), profiles).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    for own in (docs, docs.limit(0)):
        profiles = langid.fit(own, F.lit(True))
        assert profiles.languages == []
        assert [tuple(r)[-2:] for r in langid.identify(docs, profiles).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op13_language"](spark, folder)
    assert found.count() == table(spark, folder, "documents").count()
    right = found.join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert found.filter(F.col("held_out") != (fold(F.col("doc_id"), 5) == 0)).count() == 0
