import random
import re

import numpy as np
import pytest

from loomgrid.llm import neardup as N
from loomgrid.llm.common import U, mix
from loomgrid.llm.components import connected_components

from .fixtures import WORDS, edited, empty, messy, messy_rows, words


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent=80):
    sets = [(d, shingles(t, k)) for d, t in rows]
    ids = sorted({d for d, _ in sets if d is not None})
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((str(d), len(s), str(d if d is None or not s else root(d))) for d, s in sets)


def run(df, k):
    return sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in N.near_groups(df, k=k).collect())


@pytest.mark.parametrize("k", [4, 5])
def test_messy_equals_brute_force(spark, k):
    assert run(messy(spark), k) == brute([r[:2] for r in messy_rows()], k)


def test_chains_and_large_groups_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, words(900, 150)) for i in range(1000, 1005)]
    chain = words(77, 200).split(" ")
    for i in range(40):  # each next one is near the last, the ends are far apart
        at = r.randrange(len(chain))
        chain = chain[:at] + [r.choice(WORDS)] + chain[at + 1 :]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, edited(words(5, 120), i, r.choice([0.01, 0.03, 0.05, 0.08]))) for i in range(150)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 4) == brute(rows, 4)


def test_long_words_that_differ_are_unlike(spark):
    """Two words of 1,024 bytes whose running polynomial sums are equal modulo 2**64, whatever the base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, f"x y z {a} x y z {b}"), (6, f"x y z {a} x y z {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (1, 4):
        assert run(df, k) == brute(rows, k)
    assert {r["id"]: r["n_shingles"] for r in N.near_groups(df, k=1).collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 5, 6: 4}


def test_byte_hashes_depend_on_the_bytes_alone():
    from loomgrid.llm.common import LONG_WORD, NOT_ALNUM, SPACE, Places, word_digests
    from loomgrid.llm.common import words as places

    r = random.Random(2)
    own = ["".join(r.choice("abAB") for _ in range(n)) for n in [*range(1, 40), LONG_WORD - 1, LONG_WORD, LONG_WORD + 1, 3000] for _ in range(3)]
    text = " ".join(own + own[::-1]).encode()
    data, off = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text) // 2, len(text)])
    for gaps in (SPACE, NOT_ALNUM):
        hashes, first = word_digests(data, off, gaps)
        starts, ends, want = places(data, off, gaps)
        assert first.tolist() == want.tolist()
        low = [data[a:b].tobytes().lower() for a, b in zip(starts, ends)]
        for h in hashes:
            assert len(set(zip(low, h.tolist()))) == len(set(low)) == len(set(h.tolist()))
    keys = np.unique(hashes[0])
    found = Places(keys[::2]).find(keys)
    assert found[::2].tolist() == list(range(len(keys[::2]))) and set(found[1::2].tolist()) == {-1}
    assert Places(keys[:0]).find(keys).tolist() == [-1] * len(keys)


def test_hot_keys_are_attached_without_a_shuffle(spark, monkeypatch):
    from loomgrid.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(100)], "k long, v long")
    values = common.cut(rows.groupBy("k").count().withColumnRenamed("count", "n"))
    out = common.attach(rows, values, ["k"], "n")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.join(values, "k").collect()))
    assert common.attach(rows.limit(0), values.limit(0), ["k"], "n").count() == 0


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 16)
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "WIDTH", 512)
    r = random.Random(9)
    rows = [(i, edited(words(8, 100), i, r.choice([0.02, 0.05, 0.09]))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 4) == brute(rows, 4)


def test_signature_equals_the_sequential_algorithm():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 3, 50, 700]
    h = rng.integers(0, 1 << 63, sum(sizes), dtype=np.int64).astype(U)
    before = np.concatenate(([0], np.cumsum(sizes)))
    slots = 32
    got = N.signatures(h, before, slots)
    for i in range(len(sizes)):
        want = [N.EMPTY] * slots
        for e in h[before[i] : before[i + 1]]:
            perm = list(range(slots))
            for j in range(slots):
                x = int(mix(np.array([e + U(((j + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)], dtype=U))[0])
                k = j + (((x & 0xFFFFFFFF) * (slots - j)) >> 32)
                perm[j], perm[k] = perm[k], perm[j]
                want[perm[j]] = min(want[perm[j]], (j << 32) + (x >> 32))
        assert got[i].tolist() == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.int64).astype(U))
    a, b = h[:900], h[100:]
    sig = N.signatures(np.concatenate((a, b)), np.array([0, 900, 1800]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x["node"]: x["component"] for x in connected_components(df).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert connected_components(df.limit(0)).count() == 0


def test_dedup_and_empty(spark):
    docs = messy(spark)
    out = N.near_dedup(docs)
    assert out.schema == docs.schema
    gone = {d for d, _, c in brute([r[:2] for r in messy_rows()], 5) if d != c}
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in messy_rows() if str(r[0]) not in gone)
    assert N.near_groups(empty(spark)).count() == 0 and N.near_dedup(empty(spark)).count() == 0
