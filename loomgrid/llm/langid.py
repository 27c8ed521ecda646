"""Language identification by a byte convolutional network in numpy.

Bytes are folded to 128 symbols (ASCII letters without case, one symbol for all other ASCII, UTF-8
lead and continuation bytes). Filters of 2, 3 and 4 symbols run over fixed-length windows, are max
pooled over the window, rectified and fed to a softmax. As the input is one-hot, a filter is a sum of
table rows; for prediction the rows of two neighbouring symbols are added beforehand. Every window of
every text is read; a text gets the mean of its windows' probabilities, weighted by their letters.

Defined cases: a text that is null or has no letter is `und` with score 0; very long texts are read in
windows; rows repeated get the same answer; without labelled rows everything is `und`; of equally likely
languages the first by code point is taken; an empty table gives an empty result. Results are columns of
expressions, so other columns of a table cannot clash with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, send, smallest_hashes, text_chunks, tidy

#: Labelled rows the classifier is fitted on: at most so many of each language, and so many in all.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 12_000
#: Windows taken from each sampled text, at places that a hash picks.
WINDOWS_PER_TEXT = 3
LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 16
SYMBOLS = 128
EPOCHS, BATCH, RATE = 5, 64, 0.01


def _symbols() -> np.ndarray:
    out = np.ones(256, dtype=np.uint8)  # 0 stands behind the end of a text, 1 for other ASCII
    for i in range(26):
        out[65 + i] = out[97 + i] = 2 + i
    out[128:192] = 28 + np.arange(64)
    out[192:256] = 92 + np.arange(64) % 32
    return out


SYMBOL = _symbols()


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the windows of each text, LENGTH apart and with the next 3 symbols, and the text of each."""
    codes = np.concatenate((SYMBOL[data], np.zeros(1, dtype=np.uint8)))
    count = -(-np.diff(off) // LENGTH)
    text = np.repeat(np.arange(len(count)), count)
    start = off[text] + LENGTH * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    at = start[:, None] + np.arange(LENGTH + max(WIDTHS) - 1)
    at[at >= off[text + 1][:, None]] = len(data)
    return codes[at], text


class Network:
    """Filters w[width] of shape (width, SYMBOLS, FILTERS) and a softmax layer."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), dtype=np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, where = [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            z = sum(table[j][x[:, j : j + LENGTH]] for j in range(w))
            best = z.argmax(axis=1)
            where.append(best)
            top.append(np.take_along_axis(z, best[:, None, :], axis=1)[:, 0])
        return np.concatenate(top, axis=1), np.concatenate(where, axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        """Adam on the cross-entropy; the gradient of a filter reaches the symbols where it was largest."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.out, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                b = order[i : i + BATCH]
                top, where = self.pooled(x[b])
                h = np.maximum(top, 0)
                p = _softmax(h @ self.out + self.bias)
                p[np.arange(len(b)), y[b]] -= 1
                p /= len(b)
                back = (p @ self.out.T) * (top > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g, part = np.zeros_like(self.filters[k]), slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        symbol = np.take_along_axis(x[b], where[:, part] + j, axis=1)
                        np.add.at(g[j], (symbol, np.arange(FILTERS)), back[:, part])
                    grads.append(g)
                grads += [h.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, a, s in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def joined(self) -> list[np.ndarray]:
        """Tables over two neighbouring symbols for the widths 2, 3 and 4, and the last symbol of width 3."""
        two, three, four = self.filters
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS))
        return [pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3])]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def probabilities(net: Network, tables: list[np.ndarray], x: np.ndarray, rows: int = 64) -> np.ndarray:
    """Class probabilities of windows, some rows at a time so that the activations stay in the cache."""
    out = np.empty((len(x), FILTERS * len(WIDTHS)), dtype=np.float32)
    for i in range(0, len(x), rows):
        part = x[i : i + rows]
        pair = part[:, :-1].astype(np.int32) * SYMBOLS + part[:, 1:]
        first, third = np.ascontiguousarray(pair[:, :LENGTH]), np.ascontiguousarray(pair[:, 2 : LENGTH + 2])
        a = tables[0].take(first, axis=0)
        out[i : i + rows, :FILTERS] = a.max(axis=1)
        a = tables[1].take(first, axis=0)
        a += tables[2].take(part[:, 2 : LENGTH + 2], axis=0)
        out[i : i + rows, FILTERS : 2 * FILTERS] = a.max(axis=1)
        a = tables[3].take(first, axis=0)
        a += tables[4].take(third, axis=0)
        out[i : i + rows, 2 * FILTERS :] = a.max(axis=1)
    return _softmax(np.maximum(out, 0) @ net.out + net.bias)


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network fitted on a bounded sample of rows with a language; None without such rows."""
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null")
    chosen = smallest_hashes(own, F.col("id").cast("string"), SAMPLE_PER_LANGUAGE, per="lang")
    chosen = smallest_hashes(chosen, F.col("id").cast("string"), SAMPLE_ROWS).select("id").collect()
    if not chosen:
        return None
    # the sample is bounded, so its identifiers are broadcast; one row for each, whichever order rows come in
    (picked,) = free_names(docs, "picked")
    ids = docs.sparkSession.createDataFrame([(r["id"],) for r in chosen], T.StructType([T.StructField(picked, docs.schema[id_col].dataType)]))
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).join(F.broadcast(ids), F.col(id_col) == F.col(picked)).select(id_col, text_col, lang_col)
    rows = rows.groupBy(id_col).agg(F.min(F.struct(F.col(text_col), F.col(lang_col))).alias(picked)).select(id_col, f"{picked}.*")
    cuts = [
        F.substring(text_col, 1 + F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(k)), F.greatest(F.lit(1), F.length(text_col) - LENGTH)).cast("int"), F.lit(LENGTH))
        for k in range(WINDOWS_PER_TEXT)
    ]
    rows = rows.select(F.col(lang_col).alias("lang"), F.array(*cuts).alias("cuts")).toPandas()
    labels = sorted(set(rows["lang"]))
    if not labels:
        return None
    texts = [(c, labels.index(lang)) for lang, cut in zip(rows["lang"], rows["cuts"], strict=True) for c in cut]
    texts.sort()  # the order in which rows arrive must not matter
    x, y = [], []
    for text, label in texts:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)[:LENGTH]
        if len(raw):
            x.append(windows(raw, np.array([0, len(raw)]))[0][0])
            y.append(label)
    return Network(labels).fit(np.array(x), np.array(y)) if x else None


def predict_language(text: str, df: DataFrame, model: Network | None) -> Column:
    """A column struct<lang_pred, score> for one text column of df."""
    held = send(df, (model, model and model.joined()))

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net, tables = held.value
        for batch in batches:
            lang, score = ["und"] * len(batch), np.zeros(len(batch))
            for row, data, off in text_chunks(batch) if net else ():
                x, of = windows(data, off)
                letters = (x[:, :LENGTH] > 1).sum(axis=1).astype(np.float64)
                p = probabilities(net, tables, x) * letters[:, None]
                total = np.zeros((len(off) - 1, len(net.labels)))
                np.add.at(total, of, p)
                n = np.bincount(of, weights=letters, minlength=len(off) - 1)
                has_ascii = np.bincount(of, weights=((x[:, :LENGTH] > 1) & (x[:, :LENGTH] < 28)).sum(axis=1), minlength=len(off) - 1) > 0
                for i in np.flatnonzero(n > 0):
                    if has_ascii[i] or any(c.isalpha() for c in batch[row + int(i)].as_py()):
                        best = int(total[i].argmax())
                        lang[row + i], score[row + i] = net.labels[best], min(1.0, total[i, best] / n[i])
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])
        tidy()

    return predict(F.col(text))
