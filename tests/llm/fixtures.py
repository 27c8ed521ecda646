"""Small tables with all that an operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, n long, key string, digest string, size long, target double, score double, ids string, p string"
WORDS = [f"w{i}" for i in range(400)]


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split(" "))


def messy_rows():
    """Nulls everywhere, empty and white texts, a very long text, ties, repeated rows, near copies, short texts."""
    texts = [(i, words(i, 40)) for i in range(1, 9)]
    texts += [(10 + i, edited(words(1, 40), i, 0.02 * i)) for i in range(6)]
    texts += [(20, None), (21, ""), (22, " \t\n "), (23, "one"), (24, "One\tone"), (25, "one  one"), (26, words(5, 30_000)), (27, words(5, 30_000) + " tail"), (28, "été naïve 日本語 🙂" * 3), (29, "12345 !!! ???")]
    texts += [(5, words(5, 40)), (5, words(5, 40)), (40, words(3, 40)), (41, words(3, 40)), (42, words(3, 40).replace(" ", "\n ")), (None, words(3, 40)), (None, None), (None, "lone text without id")]
    out = []
    for i, (doc, text) in enumerate(texts):
        lang, source = (None, None) if i % 7 == 0 else ("en" if i % 2 else "fr", f"src{i % 3}")
        out.append((doc, text, lang, source, None if text is None else len(text), -1, "x", None, "k", None, 7, 0.5, None, "i", None))
    return out


def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
