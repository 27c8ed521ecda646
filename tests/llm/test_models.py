"""Language ID, toxicity and language-model scoring."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.llm import langid, lmscore, toxicity
from loomgrid.llm import queries as Q

from .fixtures import empty, messy, messy_rows

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    out = Q.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] > 150 and r[1] > 0.97


def test_language_edges(spark):
    docs = messy(spark)
    model = langid.train_language_model(docs)
    rows = docs.withColumn("q", langid.predict_language("text", docs, model)).collect()
    assert len(rows) == len(messy_rows())
    for r in rows:
        und = not any(c.isalpha() for c in r["text"] or "")
        assert (r["q"]["lang_pred"] == "und") == und and 0 <= r["q"]["score"] <= 1 and (not und or r["q"]["score"] == 0)
    assert langid.train_language_model(empty(spark)) is None
    assert empty(spark).withColumn("q", langid.predict_language("text", docs, model)).count() == 0
    none = docs.withColumn("q", langid.predict_language("text", docs, None)).select("q.*").distinct().collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]


def test_tables_of_pairs_equal_the_network():
    net = langid.Network(["a", "b", "c"])
    x, _ = langid.windows(np.frombuffer("Größe und été, 123 ".encode() * 40, dtype=np.uint8), np.array([0, 300, 300, 840]))
    want = langid._softmax(np.maximum(net.pooled(x)[0], 0) @ net.out + net.bias)
    assert np.allclose(langid.probabilities(net, net.joined(), x), want, atol=1e-5)


def maximal(scores):
    """All maximal scoring segments by their definition: the best segment (shortest, first), then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) <= 1e-9 and (j - i) < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    right = [(a + j, b + j, c) for a, b, c in maximal(scores[j:])]
    return [*maximal(scores[:i]), best, *right]


@given(st.lists(st.sampled_from([-1.0, -1.0, 2.0, 3.5, 0.75]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_segments_are_all_maximal_ones(scores):
    at = np.array([i for i, s in enumerate(scores) if s > 0], dtype=np.int64)
    got = toxicity.segments(at, np.array([scores[i] for i in at]), -1.0)
    want = maximal(scores)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert r[0] >= 0.92 and r[1] <= 0.002


def plain_forms(text):
    """(whole word, beginning) of each token, by plain regexes."""
    tokens = [m[0].lower() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    return [((b"word", t), (b"start", t[: toxicity.BEGINNING]) if len(t) > toxicity.BEGINNING else (b"word", t)) for t in tokens]


def brute_toxicity(docs, labels):
    """Scores by the definition in the module's text: docs id -> text, labels id -> 0 or 1; no sampling."""
    n = {v: sum(1 for d in labels if labels[d] == v) for v in (0, 1)}
    have, corpus = {0: Counter(), 1: Counter()}, Counter()
    for d, text in docs.items():
        forms = {f for pair in plain_forms(text) for f in pair}
        corpus.update(forms)
        if d in labels:
            have[labels[d]].update(forms)
    score = {}
    for f in {*have[0], *have[1]}:
        if have[0][f] + have[1][f] >= toxicity.LEAST_TEXTS:
            prior = toxicity.PRIOR * corpus[f] / len(docs)
            t, o = have[1][f] + prior, have[0][f] + prior
            value = math.log(t / (n[1] + toxicity.PRIOR - t)) - math.log(o / (n[0] + toxicity.PRIOR - o)) - toxicity.CAUTION * math.sqrt(1 / t + 1 / o)
            score[f] = value if value >= toxicity.LEAST_LOG_ODDS else toxicity.NEUTRAL
    rated = {d: [next((score[f] for f in pair if f in score), toxicity.NEUTRAL) for pair in plain_forms(text)] for d, text in docs.items()}
    benign = [s for d in labels if labels[d] == 0 for s in rated[d]]
    low, high = 1e-6, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(math.exp(min(700, mid * s)) for s in benign) < len(benign) else (low, mid)
    e = {d: [len(s) * math.exp(-low * x) for *_, x in maximal(s)] for d, s in rated.items()}
    least = sorted(min(e[d], default=math.inf) for d in labels if labels[d] == 0)
    some = [x for x in least if x < math.inf]
    k = toxicity.SIGNIFICANT / some[min(len(some) - 1, int(toxicity.SIGNIFICANT * len(least)))] if some else 1.0
    x = {d: (min(40.0, max(-5.0, -math.log(max(k * min(v), 1e-300)))) if v else -5.0, math.log1p(sum(k * y < toxicity.SIGNIFICANT for y in v))) for d, v in e.items()}
    w = toxicity._logistic(np.array([x[d] for d in sorted(labels)]), np.array([float(labels[d]) for d in sorted(labels)]))
    return {d: 1 / (1 + math.exp(-(w[0] + w[1] * a + w[2] * b))) for d, (a, b) in x.items()}


def test_toxicity_equals_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 3)
    rng = random.Random(6)
    docs, labels = {}, {}
    for i in range(160):
        words = [rng.choice(["alpha", "beta", "gammas", "Gammarus", "été", "x1"]) for _ in range(rng.randrange(1, 25))]
        if i % 4 == 0:
            words[len(words) // 2 :] = [rng.choice(["vile", "VILE", "wretched", "wretches", "wretchedly"]) for _ in range(3)]
        elif i % 9 == 0:
            words.append("vile")
        docs[i] = " ".join(words)
        if i % 3:
            labels[i] = int(i % 4 == 0)
    docs |= {200: None, 201: "", 202: "... !"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0, y) for d, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.op2_toxicity(spark, str(tmp_path)).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs}
    want = brute_toxicity(docs, {d: y for d, y in labels.items() if not held[d]})
    assert got.keys() == docs.keys() and len({round(v, 6) for v in want.values()}) > 5
    for d in docs:
        assert abs(got[d]["score"] - want[d]) < 1e-6 and got[d]["held_out"] == held[d] and got[d]["predicted"] == int(want[d] >= 0.5)


def test_toxicity_edges_and_passages(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = docs.withColumn("q", toxicity.toxic_passages("text", docs, toxicity.train_toxicity(docs, labels))).collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r["q"]["score"] <= 1 for r in rows)
    none = toxicity.train_toxicity(docs, labels.where("doc_id is null"))
    assert {r["q"]["score"] for r in docs.withColumn("q", toxicity.toxic_passages("text", docs, none)).collect()} == {0.0}
    assert toxicity.train_toxicity(empty(spark), labels.limit(0)).known is False
    assert empty(spark).withColumn("q", toxicity.toxic_passages("text", docs, none)).count() == 0
    data = np.frombuffer(b"vile wretched wretc", dtype=np.uint8)
    whole, start, _ = toxicity.forms(data, np.array([0, len(data)]))
    assert whole[0] == start[0] and len({whole[1], start[1], whole[2], start[2]}) == 3
    model = toxicity.Model(whole[:1], np.array([5.0]), 2.0, 0.01, (-3.0, 0.5, 0.5))
    one = spark.createDataFrame([("été vile words of no use, vile",)], "text string")
    got = one.withColumn("q", toxicity.toxic_passages("text", one, model)).first()["q"]
    assert [(p["start"], p["end"]) for p in got["passages"]] == [(4, 30)] and got["score"] > 0.5


def brute_difference(rows, target):
    tokens = {d: [m.lower().decode() for m in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())] for d, t in rows}
    single = [Counter(), Counter()]
    for d, w in tokens.items():
        single[0].update(w)
        if d in target:
            single[1].update(w)
    total = sum(single[0].values())
    vocabulary = {w for w, n in single[0].items() if n >= total * lmscore.LEAST_SHARE}
    named = {d: [w if w in vocabulary else "<unk>" for w in ws] for d, ws in tokens.items()}
    uni, pair, left = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for d, ws in named.items():
        for m in (0, 1):
            if m == 0 or d in target:
                uni[m].update(ws)
                pair[m].update(zip(["<s>", *ws], ws))
                left[m].update([*ws, *(["<s>"] if ws else [])])
    size, out = len(vocabulary) + 1, {}
    for d, ws in named.items():
        diff = 0.0
        for a, b in zip(["<s>", *ws], ws):
            loss = []
            for m in (0, 1):
                one = (uni[m][b] + lmscore.ADDED) / (sum(uni[m].values()) + lmscore.ADDED * size)
                two = pair[m][a, b] / left[m][a] if left[m][a] else one
                loss.append(-math.log(lmscore.BIGRAM_WEIGHT * two + (1 - lmscore.BIGRAM_WEIGHT) * one))
            diff += loss[1] - loss[0]
        out[d] = (len(ws), diff / max(1, len(ws)))
    return out


def test_cross_entropy_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "LEAST_SHARE", 0.004)
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 1000)
    rows = {r[0]: r[1] for r in messy_rows() if r[0] is not None}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(1,), (2,), (2,), (10,), (999,)], "doc_id long")
    got = {r["id"]: (r["n_tokens"], r["score"]) for r in lmscore.cross_entropy_difference(docs, targets).collect()}
    want = brute_difference(list(rows.items()), {1, 2, 10})
    assert got.keys() == want.keys()
    for d, (n, score) in want.items():
        assert got[d][0] == n and abs(got[d][1] - score) < 1e-9


def test_every_target_text_counts(spark):
    """More targets than were once sent to the executors; the last ones alone hold the word b."""
    n = 20_500
    docs = spark.range(n).selectExpr("id AS doc_id", f"CASE WHEN id < {n // 2} THEN 'a a' ELSE 'b a' END AS text")
    got = {r["id"]: (r["n_tokens"], r["score"]) for r in lmscore.cross_entropy_difference(docs, docs.select("doc_id")).collect()}
    assert len(got) == n and all(size == 2 and abs(score) < 1e-12 for size, score in got.values())


def test_no_word_is_dropped_for_a_large_corpus(spark, monkeypatch):
    """Words that occur once in more than 100,000 tokens, by their own counts, over several chunks and buckets."""
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 100_000)
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1000)) + f" rare{i} seldom{i % 7}") for i in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    targets = spark.range(0, 220, 3).withColumnRenamed("id", "doc_id")
    got = {r["id"]: (r["n_tokens"], r["score"]) for r in lmscore.cross_entropy_difference(docs, targets).collect()}
    monkeypatch.setattr(lmscore, "LEAST_SHARE", 0.0)
    want = brute_difference(rows, set(range(0, 220, 3)))
    assert got.keys() == want.keys()
    for d, (n, score) in want.items():
        assert got[d][0] == n and abs(got[d][1] - score) < 1e-9


def test_cross_entropy_edges(spark):
    targets = spark.createDataFrame([(1,)], "doc_id long")
    assert lmscore.cross_entropy_difference(messy(spark), targets).count() == len(messy_rows())
    assert lmscore.cross_entropy_difference(messy(spark), targets.limit(0)).count() == len(messy_rows())
    assert lmscore.cross_entropy_difference(empty(spark), targets).count() == 0
