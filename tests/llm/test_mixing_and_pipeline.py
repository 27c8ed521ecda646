import hashlib
import math
import re
from collections import Counter, defaultdict

import base64
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from loomgrid.llm import mixing

from .fixtures import empty, messy, messy_rows
from .test_exactdedup import norm
from .test_neardup import brute


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, rest, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            return sizes, target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= full
    return sizes, target


def check_mix(rows, got):
    sizes, target = brute_targets(rows)
    taken, longest = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6


def test_mix_meets_targets(spark):
    rows = [(r[0], r[1], r[3]) for r in messy_rows()]
    got = mixing.mix(messy(spark)).collect()
    check_mix(rows, got)
    again = mixing.mix(messy(spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_many_rows_and_whole_epochs_first(spark):
    rows = [(i, "word " * (1 + i % 17), ["a", "b", "c", None][0 if i % 3 == 0 else 1 + i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_mix(rows, got)
    for r in got:
        if r["size"] and r["target"] >= r["source_size"]:
            assert r["taken"] >= r["size"]


def test_mixed_repeats_rows(spark):
    docs = messy(spark)
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    assert Counter(size_of(r["text"]) > 0 for r in out.collect())[False] == 0
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_bear_messy_and_empty_tables(spark, name, stage):
    docs = messy(spark)
    out = stage(spark, docs, "")
    new = ["_ids", "n_tokens", "round_trip"] if name == "bpe" else []  # the table has a column ids of its own
    assert out.columns == docs.columns + new
    out.collect()
    if new:
        had = sorted((str(r["doc_id"]), str(r["text"]), r["ids"]) for r in docs.collect())
        assert sorted((str(r["doc_id"]), str(r["text"]), r["ids"]) for r in out.collect()) == had
    assert stage(spark, empty(spark), "").count() == 0


def test_run_equals_brute_force_by_stage(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == sorted(rows)
    first = {}
    for d in sorted(rows):
        first.setdefault(norm(rows[d]["text"]), d)
    exact = corpus_pipeline.exact(spark, docs, "")
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values())
    near = corpus_pipeline.near(spark, exact, "")
    want = [int(d) for d, _, c in brute([(d, rows[d]["text"]) for d in sorted(first.values())], 5) if d == c]
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(want)
    mix = {r["id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(near).collect()}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter(r["doc_id"] for r in out) == Counter({d: n for d, n in mix.items() if n})
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert r["ids"] == enc.encode_ordinary(r["text"]) and r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert hashlib.md5(r["text"].encode()).digest() == hashlib.md5(rows[r["doc_id"]]["text"].encode()).digest()
