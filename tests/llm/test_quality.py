import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quantloom.llm import quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.scored(docs.withColumn("score", F.lit("other")), quality.fit(docs, labels))
    rows = scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum((r.score >= 0.3) == r.quality for r in rows) >= 0.97 * len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(40)] + [(1, None, 0), (None, 1, 0), (101, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels)
    got = quality.scored(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert quality.scored(no_docs, model).count() == 0
    none = quality.scored(odd_docs, quality.fit(odd_docs, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def plain_score(text, model):
    """The probability a word and an n-gram at a time."""
    total, features, before = 0.0, 0, None
    for word in (text or "").split():
        w, before = (quality.AGAIN if word == before else word), word
        buckets = [zlib.crc32(w.encode()) % quality.BUCKETS]
        marked = f"<{w}>"
        for n in quality.GRAMS:
            for a in range(len(marked) - n + 1):
                h = 0
                for letter in marked[a : a + n]:
                    h = (h * int(quality.MULTIPLIER) + ord(letter)) % 2**64
                buckets.append(((h * int(quality.MIX) + n) % 2**64 >> 40) % quality.BUCKETS)
        total += sum(model.margin[b] for b in buckets)
        features += len(buckets)
    return 1 / (1 + math.exp(-(total / max(1, features) + model.bias)))


def test_scores_are_the_plain_ones(spark, odd_docs):
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(0, 3, quality.BUCKETS), 0.25)
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id <> 4").collect()} | {900: "a a a b  b\tc", 901: "ünïcode 日本語 🙂🙂 <x>"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.scored(docs, model).collect():
        assert abs(r.score - plain_score(texts[r.doc_id], model)) < 1e-9, r.doc_id
