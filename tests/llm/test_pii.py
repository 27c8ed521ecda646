import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.llm import pii
from loomgrid.llm import queries as Q

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            n = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(n) <= 19 and pii.luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.text(alphabet="0123456789+@.-() ab_é", max_size=120))
@settings(max_examples=500, deadline=None)
def test_patterns_equal_plain_regexes(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["a.b@c.d, x@y a@b.co@d.ef", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1 (389) 555-5010 z", "@@a@b.c", "300.1.1.1 1.1.1.255"])
def test_fixed(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for text in ("9" * 200_000, "a" * 200_000, "a" * 100_000 + "@", "+1" * 50_000, "1.2." * 30_000):
        pii.base_spans(text)


@given(st.integers(0, 2000))
@settings(max_examples=200, deadline=None)
def test_windows_cover_every_character(size):
    starts = pii.window_starts(size)
    assert starts == sorted(set(starts)) and all(s % pii.STRIDE == 0 for s in starts)
    assert {i for s in starts for i in range(s, min(size, s + pii.LENGTH))} == set(range(size))


def random_tagger(seed):
    rng = np.random.default_rng(seed)
    tagger = pii.Tagger(seed)
    tagger.p["t"] = rng.normal(0, 0.5, tagger.p["t"].shape)
    tagger.p["o"] *= 4
    return rng, tagger


def test_gradient():
    rng, tagger = random_tagger(0)
    w, y = rng.integers(0, 130, (3, 24)), np.zeros((3, 24), dtype=np.int64)
    y[0, 3:9], y[1, :3] = [1, 2, 2, 2, 2, 2], [3, 4, 4]
    _, g = tagger.gradient(w, y)
    places = (("x", (0, 2, 5)), ("x", (1, 3, 40)), ("h", (0, 3, 40)), ("h", (1, 5, 7)), ("b", (1, 17)), ("e", (int(w[0, 3]), 2)), ("o", (5, 2)), ("c", (1,)), ("t", (0, 1)), ("t", (2, 0)))
    for name, at in places:
        old = tagger.p[name][at]
        tagger.p[name][at] = old + 1e-5
        up = tagger.gradient(w, y)[0]
        tagger.p[name][at] = old - 1e-5
        down = tagger.gradient(w, y)[0]
        tagger.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_both_layouts_are_one_network():
    rng, tagger = random_tagger(3)
    w = rng.integers(0, 130, (7, 33)).astype(np.uint8)
    want = (tagger.states(w, []) @ tagger.p["o"] + tagger.p["c"]).transpose(1, 0, 2)
    assert np.allclose(tagger.emissions(w, np.float64), want, atol=1e-12) and np.allclose(tagger.emissions(w), want, atol=1e-4)


def test_decoding_equals_all_paths():
    """Posteriors, the best path and the sum over paths of short windows, against every allowed tag sequence."""
    rng, tagger = random_tagger(1)
    em = rng.normal(0, 1.5, (4, 4, pii.TAGS))
    post, _, total = tagger.marginals(em)
    best, loud = tagger.viterbi(em), tagger.loud(em)
    for n in range(len(em)):
        paths = {}
        for path in itertools.product(range(pii.TAGS), repeat=4):
            if tagger.start[path[0]] and all(tagger.allowed[i, j] for i, j in itertools.pairwise(path)):
                paths[path] = sum(em[n, i, t] for i, t in enumerate(path)) + sum(tagger.p["t"][i, j] for i, j in itertools.pairwise(path))
        mass = {path: math.exp(v) for path, v in paths.items()}
        assert abs(total[n] - math.log(sum(mass.values()))) < 1e-9
        assert tuple(best[n]) == max(paths, key=paths.get)
        want = sum(v for path, v in mass.items() if path[2] == 3) / sum(mass.values())
        assert abs(post[n, 2, 3] - want) < 1e-9
        assert loud[n] == (mass[0, 0, 0, 0] / sum(mass.values()) <= 0.5 * math.exp(1e-3))


def test_quiet_windows_have_no_span():
    rng, tagger = random_tagger(2)
    tagger.p["c"][0] += 5
    em = tagger.emissions(rng.integers(0, 130, (300, 16)).astype(np.uint8))
    quiet = ~tagger.loud(em)
    assert quiet.any() and not quiet.all()
    assert not tagger.viterbi(em[quiet].astype(np.float64)).any()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def tagger(documents):
    return pii.train_tagger(documents.where("doc_id % 2 = 0"))


def test_added_spans_on_texts_not_trained_on(documents, tagger):
    """Respelled spans, which the patterns miss, put into texts that the tagger has not seen; and those texts as they are."""
    texts = [r["text"] for r in documents.where("doc_id % 2 = 1").orderBy(F.xxhash64("doc_id")).limit(1200).collect()]
    texts = [t for t in texts if t.count(" ") > 20]
    rng = np.random.default_rng(8)
    words = sorted({w.lower() for t in texts[:200] for w in re.findall("[A-Za-z]{2,12}", t)})
    items, put = [], []
    for i, text in enumerate(texts):
        gaps = [m.end() for m in re.finditer(" ", text)]
        at, kind = gaps[len(gaps) // 2], pii.KINDS[i % 4]
        span = pii.made_span(rng, kind, words, False)
        new = text[:at] + span + " " + text[at:]
        base = pii.base_spans(new)
        if not any(a < at + len(span) and b > at for _, a, b in base):
            items.append((new, base))
            put.append((kind, at, at + len(span)))
    found = pii.added_spans(tagger, items)
    extra = [s for own, (_, base) in zip(found, items, strict=True) for s in set(own) - set(base)]
    for kind in pii.KINDS:
        own = [p in f for p, f in zip(put, found, strict=True) if p[0] == kind]
        assert len(own) > 100 and np.mean(own) > 0.85, (kind, np.mean(own))
    assert sum(s in put for s in extra) > 0.95 * len(extra)
    plain = pii.added_spans(tagger, [(t, pii.base_spans(t)) for t in texts])
    assert sum(len(own) - len(pii.base_spans(t)) for own, t in zip(plain, texts, strict=True)) <= 2


def test_query_equals_plain_regexes(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in Q.op9_personal_data(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert rows.keys() == {r["doc_id"] for r in docs}
    shown = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for d in docs:
        base, r = brute(d["text"] or ""), rows[d["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert set(shown([s]) for s in base) <= set(r["spans"].split(",")) | {""}


def test_columns(spark, tagger):
    texts = ["call +1 (389) 555-5010 now", None, "", "mail a@b.co or c@d.ef", "plain words only", "ip 10.0.0.1", "call her (389) 555-5010 today", "word " * 40_000 + "card 4111.1111.1111.1111 end"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = df.withColumn("p", pii.personal_data("text", df, tagger)).orderBy("doc_id").collect()
    for r in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in r["p"]["base"]]
        every = [(s["kind"], s["start"], s["end"]) for s in r["p"]["spans"]]
        assert base == brute(r["text"] or "") and set(base) <= set(every)
    assert [tuple(s) for s in rows[6]["p"]["spans"]] == [("phone", 9, 23)]
    assert [tuple(s) for s in rows[7]["p"]["spans"]] == [("card", 200_005, 200_024)]
    clean = df.where("text is null or text = ''")
    assert pii.train_tagger(clean) is None
    assert all(r["q"]["spans"] == [] for r in clean.withColumn("q", pii.personal_data("text", clean, None)).collect())
    assert df.limit(0).withColumn("q", pii.personal_data("text", df, tagger)).count() == 0 and pii.train_tagger(df.limit(0)) is None


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """Texts that a great share of the rows have are one text of the sample."""
    monkeypatch.setattr(pii, "SAMPLE_TEXTS", 20)
    seen = []
    monkeypatch.setattr(pii, "trained", lambda windows: seen.extend(windows))
    df = spark.createDataFrame([("same text 12345",)] * 400 + [(f"text number {i}",) for i in range(300)], "text string")
    pii.train_tagger(df)
    assert len(seen) == len(set(seen)) == 20


class Runs(pii.Tagger):
    """Every run of symbols but blanks, as far as the window shows it."""

    def spans(self, w):
        shown = ["".join("_" if c in (32, 129) else "x" for c in row) for row in w]
        return [[("email", m.start(), m.end(), 0.99) for m in re.finditer("x+", s)] for s in shown]


@pytest.mark.parametrize("length", [20, 40, 50, 63, 64, 65, 130, 700])
def test_long_spans_are_found_at_every_offset(length):
    mail = "é" * (length - 12) + "é@müller.org"[-12:]
    for offset in range(70):
        text = " " * (100 + offset) + mail + " " * 150
        got = pii.added_spans(Runs(), [(text, pii.base_spans(text))])
        assert got == [[("email", 100 + offset, 100 + offset + length)]]
