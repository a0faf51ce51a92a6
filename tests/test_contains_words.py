"""Needles of several words are looked up by words, not by stretches that most texts hold."""

from leafmill.operators import contains


def test_words_of_needles_meet_by_equality(spark, monkeypatch):
    monkeypatch.setattr(contains, "FEW", 1)
    said = ["on the cat sat", "the catch", "bathe cat", "a  b c", "a b", "b a b a b", "on the cat sat", "", None, "the", " the cat"]
    asked = ["the cat", "he ca", "e cat sat", "a b", "a b a", "b  c", "n the cat s", "zz z"]
    texts = spark.createDataFrame([(t,) for t in said], "t string")
    needles = spark.createDataFrame([(n,) for n in asked], "n string")
    want = sorted((t, n) for t in said if t is not None for n in asked if n in t)
    assert sorted(map(tuple, contains.containing(texts, needles, "t", "n").collect())) == want
    monkeypatch.setattr(contains, "_by_stretches", None)
    worded = needles.filter("n not like '%  %'")
    assert sorted(map(tuple, contains.containing(texts, worded, "t", "n").collect())) == [w for w in want if "  " not in w[1]]
