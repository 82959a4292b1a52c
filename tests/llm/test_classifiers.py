import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import PROSE, frame
from trellisq.llm import quality_fm, toxicity
from trellisq.llm.common import held_out, learnable


def corpus(n, seed):
    """Texts of invented words; label 1 where one of two marked stems occurs, with endings never seen before."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ri", "no", "sel", "mu", "ke"]) for _ in range(r.randint(1, 4)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        if i % 3 == 0:
            for _ in range(max(2, len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(["blorfg", "zwuxip"]) + word()[:3]
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels, np.float32)


def test_unseen_spellings_are_caught():
    model = toxicity.train(*corpus(900, 1))
    texts, y = corpus(300, 2)
    s = model.scores(texts)
    assert (s[y == 1] >= 0.7).mean() > 0.95 and (s[y == 0] >= 0.7).mean() < 0.03
    assert np.array_equal(s, toxicity.train(*corpus(900, 1)).scores(texts))


def test_folded_scores_are_those_of_the_softmax():
    model = toxicity.train(*corpus(300, 3))
    for t in ("", "blorfg tari", "no " * 50):
        ids, _ = toxicity.subwords(toxicity.tokens(t)) if t else (np.zeros(0, int), None)
        mean = model.values[ids].astype(float).sum() / (len(ids) + toxicity.NEUTRAL)
        assert abs(model.scores([t])[0] - 1 / (1 + np.exp(-(toxicity.SCALE * mean + model.bias)))) < 1e-9


def test_interactions_in_linear_time():
    texts = [PROSE, "A!! B!! C!!", "", "w " * 30]
    model = quality_fm.train(texts * 10, np.array([1, 0, 0, 1] * 10, np.float32), epochs=3)
    got = model.scores(texts)
    for k, t in enumerate(texts):
        ids, n, s = model.features([t])
        x = np.concatenate([np.full(len(ids), 1 / max(1, n[0]) ** 0.5), s[0]])
        at = np.concatenate([ids, quality_fm.BUCKETS + np.arange(len(quality_fm.STATS))])
        v, z = model.p["V"][at], float(model.p["b"][0] + model.p["w"][at] @ x)
        z += sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_on_held_out_texts():
    good, _ = corpus(400, 5)
    bad = [" ".join(w + "$$$" for w in t.split()) if i % 2 else t.upper().replace(" ", "!! ") for i, t in enumerate(corpus(400, 6)[0])]
    model = quality_fm.train(good[:300] + bad[:300], np.array([1] * 300 + [0] * 300, np.float32))
    assert (model.scores(good[300:]) >= 0.5).mean() > 0.95 and (model.scores(bad[300:]) >= 0.5).mean() < 0.05


def test_labels_of_the_held_out_third_are_never_read(spark):
    ids = spark.range(100).select(F.col("id").alias("doc_id"), learnable(F.col("id")).alias("a"), held_out(F.col("id")).alias("b")).collect()
    assert all(r["b"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["a"] != r["b"] for r in ids)
    texts, y = corpus(240, 7)
    docs = frame(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(v), int(v)) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for module in (toxicity, quality_fm):
        a, b = ([r["score"] for r in module.score(docs, module.fit(docs, x)).orderBy("doc_id").collect()] for x in (labels, flipped))
        assert a == b


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_fm):
        model = module.fit(odd, labels)
        got = module.score(odd.withColumn("score", F.lit("old")), model).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(odd.limit(0), module.fit(odd.limit(0), labels.limit(0))).count() == 0
