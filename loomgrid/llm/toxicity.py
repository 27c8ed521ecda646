"""Toxic passages by maximum-scoring segment search.

A token has two forms: the whole word, and its beginning of BEGINNING bytes, so that inflected words
count too. A form's score is its log-odds between toxic and other labelled texts under an informative
Dirichlet prior, the form's frequency in the whole corpus, less CAUTION standard errors; both are of
numbers of texts, so no single text, however long, makes a form significant. A token is scored by its
most specific form that LEAST_TEXTS labelled texts have; tokens whose score is under LEAST_LOG_ODDS, and
all others, get a small negative score. One linear scan finds all maximal scoring segments of a text.
Scores of random text follow an extreme-value law with parameters lambda and K, so a segment of score S
in n tokens has E = K n exp(-lambda S), K calibrated on texts that are not toxic; segments of small E are
the passages, and a logistic curve fitted on labelled texts turns the best segment and the number of
passages into a probability.

Tokens are runs of letters and digits without case in A-Z. Forms are keyed by 64-bit hashes; only those of the bounded labelled sample are kept, so no table grows with the corpus, and
their corpus frequencies are counted over all texts.

Defined cases: null and empty texts have no passage and get the score of texts without one; rows
repeated get the same score; a text labelled both ways counts as toxic; without labels of both kinds
every score is 0; very long texts are scanned whole; an empty table gives an empty result; of segments
of equal score the first and shortest is the maximal one. Results are columns of expressions, so other
columns of a table cannot clash with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, Places, U, byte_hashes, cut, mix, send, smallest_hashes, text_chunks, tidy, words

#: Labelled rows the scores are learned from, at most.
SAMPLE_ROWS = 20_000
#: Bytes of the beginning of a word that is a form of it.
BEGINNING = 5
#: Weight of the prior in texts; labelled texts that a form must be in; standard errors taken off the
#: log-odds; least score of a toxic token; score of all others.
PRIOR, LEAST_TEXTS, CAUTION, LEAST_LOG_ODDS, NEUTRAL = 30.0, 8, 1.64, 1.0, -0.1
#: A segment is a passage if fewer than so many as good are expected in random text of the same length.
SIGNIFICANT = 0.05
#: -log E of a text without segments, and the most that counts.
NO_SEGMENT, MOST = -5.0, 40.0


@dataclass
class Model:
    """Sorted keys of the forms with evidence, their scores, extreme-value parameters, and the logistic curve."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: bool = True
    places: Places | None = None


def segments(at: np.ndarray, score: np.ndarray, neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, token after the last, score), where token at[i] scores
    score[i] > 0 and all others score neutral < 0. Linear in the number of positive tokens (amortised)."""
    out: list[list[float]] = []  # first, end, sum before, sum up to the end
    chain: list[int] = []  # for each segment, the last one before it with a smaller sum before it
    total, last = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total += neutral * (i - last)
        last = i + 1
        new = [i, i + 1, total, total + s]
        total += s
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= new[2]:
                j = chain[j]
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                chain.append(j)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:], chain[j:]
            j -= 1
    return [(int(a), int(b), d - c) for a, b, c, d in out]


def log_odds(toxic: np.ndarray, other: np.ndarray, corpus: np.ndarray, texts: tuple[int, int, int]) -> np.ndarray:
    """Score of each form from the toxic, other and all texts that have it; texts: how many there are of each."""
    share = np.clip(corpus / max(1, texts[2]), 1e-9, 1)
    t, o = toxic + PRIOR * share, other + PRIOR * share
    delta = np.log(t / (texts[0] + PRIOR - t + 1e-9)) - np.log(o / (texts[1] + PRIOR - o + 1e-9))
    sure = delta - CAUTION * np.sqrt(1 / t + 1 / o)
    return np.where(sure >= LEAST_LOG_ODDS, sure, NEUTRAL)


def extreme_value(tokens: int, positive: np.ndarray) -> float:
    """lambda with mean exp(lambda * score) = 1 over the tokens of texts that are not toxic; positive: their scores over 0."""

    def excess(lam: float) -> float:
        return (np.exp(np.minimum(lam * positive, 700)).sum() + (tokens - len(positive)) * np.exp(lam * NEUTRAL)) / max(1, tokens) - 1

    low, high = 1e-6, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def forms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the whole word and of the beginning of each token, and the number of tokens before each text.

    A word of no more than BEGINNING bytes is its own beginning."""
    starts, ends, first = words(data, off, NOT_ALNUM)
    low = LOWER[data]
    (whole,) = byte_hashes(low, starts, ends, 1)
    (start,) = byte_hashes(low, starts, np.minimum(ends, starts + BEGINNING), 1)
    return whole, np.where(ends - starts > BEGINNING, mix(start + U(1)), whole), first


def _texts_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _scan(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, list[tuple[int, int, float]]]]]:
    """Number of tokens before each text, and for texts with toxic tokens the scores of those and their segments."""
    if model.places is None:
        model.places = Places(model.keys)
    whole, start, first = forms(data, off)
    at = model.places.find(whole)
    other = np.flatnonzero(at < 0)
    at[other] = model.places.find(start[other])
    w = np.append(model.scores, NEUTRAL)[at]  # -1, no evidence, is the last
    hits = np.flatnonzero(w > 0)
    of = np.searchsorted(first, hits, "right") - 1
    found = {}
    for text, own in zip(*_groups(of, hits), strict=True):
        found[text] = (w[own], segments(own - first[text], w[own]))
    return first, found


def _groups(of: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    edge = np.flatnonzero(np.diff(of)) + 1
    return of[np.concatenate(([0], edge))].tolist() if len(of) else [], np.split(values, edge) if len(of) else []


def expected(model: Model, tokens: int, score: float) -> float:
    """E of a segment: how many as good are expected in a random text of so many tokens."""
    return float(model.k * tokens * np.exp(-model.scale * score))


def features(e: list[float]) -> tuple[float, float]:
    """Minus the logarithm of the least E, and the logarithm of one more than the passages."""
    if not e:
        return NO_SEGMENT, 0.0
    return float(np.clip(-np.log(max(min(e), 1e-300)), NO_SEGMENT, MOST)), float(np.log1p(sum(x < SIGNIFICANT for x in e)))


def _text_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, other): texts of the labelled sample that have each form; rows are (id, y, text)."""
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for row, data, off in text_chunks(batch.column(2)):
            whole, start, first = forms(data, off)
            keys, at = np.unique(np.concatenate((whole, start)), return_inverse=True)
            of = _texts_of(first)
            pairs = np.unique(np.concatenate((of, of)) * len(keys) + at)  # a form counts once a text
            mark, at = y[row + pairs // max(1, len(keys))], pairs % max(1, len(keys))
            counts = [np.bincount(at, weights=mark == v, minlength=len(keys)).astype(np.int64) for v in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], ["key", "toxic", "other"])
    tidy()


def _corpus(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(at, n): texts that have each of the broadcast keys, one row a key and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        places, total = Places(keys), np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for _, data, off in text_chunks(batch.column(0)):
                *both, first = forms(data, off)
                of = _texts_of(first)
                pairs = []
                for form in both:
                    at = places.find(form)
                    hit = at >= 0
                    pairs.append(of[hit] * len(keys) + at[hit])
                total += np.bincount(np.unique(np.concatenate(pairs)) % len(keys), minlength=len(keys))
        some = np.flatnonzero(total)
        for i in range(0, len(some), 50_000):
            part = some[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["at", "n"])
        tidy()

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Scores, extreme-value parameters and curve; labels are those the model may learn from."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    sample = smallest_hashes(sample.groupBy("id").agg(F.max("y").alias("y")), F.col("id"), SAMPLE_ROWS).toPandas()
    if sample["y"].nunique() < 2:
        return Model(known=False)
    # the sample is bounded, so a few thousand identifiers go to the rows; one row for each identifier
    marked = own.join(F.broadcast(own.sparkSession.createDataFrame(sample, "id long, y int")), "id")
    marked = marked.groupBy("id", "y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).select("id", "y", "text")
    send(docs, None)
    marked = cut(marked)
    texts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(texts) < 2:
        return Model(known=False)  # the labels are of other texts
    counts = marked.mapInArrow(_text_forms, "key long, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = counts.where(F.col("toxic") + F.col("other") >= LEAST_TEXTS).toArrow()
    keys, toxic, other = (counts.column(c).to_numpy() for c in ("key", "toxic", "other"))
    order = np.argsort(keys.view(U))
    keys, toxic, other = keys.view(U)[order], toxic[order], other[order]
    model = Model(keys, np.full(len(keys), NEUTRAL))
    if len(keys):
        held = send(docs, keys)
        counted = own.select("text").mapInArrow(_corpus(held), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        corpus = np.zeros(len(keys), dtype=np.int64)
        corpus[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
        model.scores = log_odds(toxic, other, corpus, (texts[1], texts[0], own.count()))
    found = marked.select("id", "y", _found("text", marked, model).alias("f")).select("id", "y", "f.*").toArrow().sort_by("id")
    tokens, y = found.column("tokens").to_numpy(), found.column("y").to_numpy().astype(np.float64)
    positive = [np.array(x, dtype=np.float64) for x in found.column("positive").to_pylist()]
    best = [np.array(x, dtype=np.float64) for x in found.column("segments").to_pylist()]
    benign = np.concatenate([np.zeros(0), *[p for p, label in zip(positive, y, strict=True) if label == 0]])
    model.scale, model.k = extreme_value(int(tokens[y == 0].sum()), benign), 1.0
    e = [[expected(model, n, s) for s in own] for n, own in zip(tokens, best, strict=True)]
    # K from the data: of texts that are not toxic, the share SIGNIFICANT may have a segment as good as that
    least = np.sort([min(x, default=np.inf) for x, label in zip(e, y, strict=True) if label == 0])
    some = least[np.isfinite(least)]
    if len(some):
        model.k = SIGNIFICANT / max(1e-300, some[min(len(some) - 1, int(SIGNIFICANT * len(least)))])
    model.curve = _logistic(np.array([features([x * model.k for x in own]) for own in e]), y)
    return model


def _found(text: str, df: DataFrame, model: Model) -> Column:
    """Struct of the number of tokens, the scores of the toxic ones, and those of the segments, of a text column."""
    held = send(df, model)

    @F.arrow_udf("tokens long, positive array<double>, segments array<double>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            tokens, positive, own = np.zeros(len(batch), dtype=np.int64), [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for row, data, off in text_chunks(batch):
                first, found = _scan(held.value, data, off)
                tokens[row : row + len(off) - 1] = np.diff(first)
                for at, (scores, rows) in found.items():
                    positive[row + at], own[row + at] = scores.tolist(), [s for *_, s in rows]
            kind = pa.list_(pa.float64())
            yield pa.StructArray.from_arrays([pa.array(tokens), pa.array(positive, kind), pa.array(own, kind)], ["tokens", "positive", "segments"])

    return search(F.col(text))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Bias and slopes by Newton steps with a little ridge; slopes are not negative."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return float(w[0]), float(max(w[1], 0)), float(max(w[2], 0))


def toxic_passages(text: str, df: DataFrame, model: Model) -> Column:
    """A column struct<score, best, many, passages> of one text column; passages have code point ranges."""
    held = send(df, model)

    @F.arrow_udf("score double, best double, many double, passages array<struct<start:int,end:int,score:double,e_value:double>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        bias, slope, more = model.curve
        for batch in batches:
            best, many, passages = np.full(len(batch), NO_SEGMENT), np.zeros(len(batch)), [[] for _ in range(len(batch))]
            for row, data, off in text_chunks(batch):
                first, found = _scan(model, data, off)
                for text, (_, rows) in found.items():
                    size = int(first[text + 1] - first[text])
                    e = [expected(model, size, s) for *_, s in rows]
                    best[row + text], many[row + text] = features(e)
                    good = [(*r, v) for r, v in zip(rows, e, strict=True) if v < SIGNIFICANT]
                    if good:
                        own = data[off[text] : off[text + 1]]
                        starts, ends, _ = words(own, np.array([0, len(own)]), NOT_ALNUM)
                        points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                        passages[row + text] = [{"start": int(points[starts[i]]), "end": int(points[ends[j - 1]]), "score": s, "e_value": v} for i, j, s, v in good]
            score = 1 / (1 + np.exp(-(bias + slope * best + more * many))) if model.known else np.zeros(len(batch))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(best), pa.array(many), pa.array(passages, kind)], ["score", "best", "many", "passages"])
        tidy()

    return search(F.col(text))
