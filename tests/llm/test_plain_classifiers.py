"""The two classifiers against plain versions in loops over words, bytes and weights."""

import math
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import linear, quality, toxicity

M = (1 << 64) - 1


def mixed(x, seed):
    x = (x + seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def corpus(spark, n=60):
    rng = random.Random(9)
    good, bad = ["Clear", "prose,", "written", "well.", "naïve"], ["CLICK", "now!!!", "$$$", "click", "x9z"]
    rows = []
    for k in range(n):
        y = k % 2
        words = [rng.choice(good if rng.random() < (0.8 if y else 0.2) else bad) for _ in range(rng.randrange(1, 30))]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words), y))
    rows += [(n, "", 1), (n + 1, None, 0), (n + 2, "word", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").cache()
    return df.select("doc_id", "text"), df.select("doc_id", F.col("y").alias("quality"), F.col("y").alias("toxic"))


def plain_ftrl(rows, size, epochs, alpha=0.3, beta=1.0, l2=1.0):
    z, n = [0.0] * size, [0.0] * size
    weight = lambda i: -z[i] / ((beta + math.sqrt(n[i])) / alpha + l2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return np.array([weight(i) for i in range(size)])


def shards(docs, labels, label):
    sample = linear.labelled_sample(docs, labels, label, F.lit(True)).collect()
    by = {}
    for r in sample:
        by.setdefault(r.shard, []).append((r.text, r.y))
    return [sorted(by[s], key=lambda r: (linear.hash_text(r[0]), r[1])) for s in sorted(by)]


def plain_quality(text, bits):
    size, features = 1 << bits, []
    words = re.findall(rb"[^ \t-\r]+", (text or "").encode())
    codes = []
    for w in words:
        shape = re.sub(rb"[0-9]+", b"0", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", w)))
        shape = re.sub(rb"([^aA0])\1+", rb"\1", shape)[:24]
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        codes.append((xxhash.xxh3_64_intdigest(low) >> 16, xxhash.xxh3_64_intdigest(shape) & 0xFFFF))
    for k, (w, s) in enumerate(codes):
        features += [mixed(w, 1), mixed(s, 2)]
        if k:
            v, t = codes[k - 1]
            features += [mixed((v * 0x9E3779B97F4A7C15 + w) & M, 3), mixed(t << 16 | s, 4), mixed(int(v == w), 5)]
    x = {}
    for f in features:
        x[f % (size - 1) + 1] = x.get(f % (size - 1) + 1, 0) + 1
    norm = max(1e-9, math.sqrt(len(features)))
    return {0: 1.0} | {i: math.sqrt(c) / norm * 3 for i, c in x.items()}


def test_quality_equals_a_plain_version(spark):
    docs, labels = corpus(spark)
    bits = 12
    weights = quality.fit(docs, labels, F.lit(True), bits=bits)
    plain = np.mean([plain_ftrl([(plain_quality(t, bits), y) for t, y in part], 1 << bits, quality.EPOCHS) for part in shards(docs, labels, "quality")], axis=0)
    assert np.abs(weights - plain).max() < 1e-4
    for r in quality.score(docs, weights).collect():
        z = sum(float(plain[i]) * v for i, v in plain_quality(r.text, bits).items())
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-3


def plain_grams(text, bits):
    data = b" " + bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + b" "
    out, bins = {}, [0] * toxicity.NORM_BINS
    for n in toxicity.ORDERS:
        for at in range(len(data) - n + 1):
            h = 1
            for k in range(n):
                h = ((h * 0x100000001B3 if k else h) + data[at + k]) & M
            i = (h * 0x9E3779B97F4A7C15 & M) >> 64 - bits
            out[i] = out.get(i, 0) + 1
            bins[i & toxicity.NORM_BINS - 1] += n == max(toxicity.ORDERS)
    return out, max(1.0, math.sqrt(sum(b * b for b in bins))) / toxicity.SCALE


def test_toxicity_equals_a_plain_version(spark):
    docs, labels = corpus(spark)
    bits, size = 12, 1 << 12
    weights = toxicity.fit(docs, labels, F.lit(True), bits=bits)
    parts = shards(docs, labels, "toxic")
    count = np.full((2, size), toxicity.SMOOTH)
    for part in parts:
        for t, y in part:
            for i, n in plain_grams(t, bits)[0].items():
                count[y][i] += n
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    learnt = []
    for part in parts:
        rows = []
        for t, y in part:
            grams, norm = plain_grams(t, bits)
            rows.append(({i: ratio[i] * n / norm for i, n in grams.items()} | {size: 1.0}, y))
        learnt.append(plain_ftrl(rows, size + 1, toxicity.EPOCHS))
    plain = np.mean(learnt, axis=0)
    assert abs(weights[0] - plain[size]) < 1e-4 and np.abs(weights[1:] - plain[:size] * ratio).max() < 1e-3
    for r in toxicity.score(docs, weights).collect():
        grams, norm = plain_grams(r.text, bits)
        z = plain[size] + sum(plain[i] * ratio[i] * n / norm for i, n in grams.items())
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-3
