import hashlib
import re

import pytest

from loomgrid.llm.exactdedup import exact_dedup, exact_groups

from .fixtures import empty, messy, messy_rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def order(doc):
    return (doc is None, doc or 0)


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_groups_equal_brute_force(spark, digest_hex):
    rows = messy_rows()
    by = {}
    for r in rows:
        by.setdefault(norm(r[1]), []).append(r[0])
    got = exact_groups(messy(spark).repartition(3), digest_hex=digest_hex).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), str(min(v, key=order)), len(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in by.items() for d in v)
    assert sorted((str(r["row"]["id"]), str(r["keep"]["id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["row"]["number"] == r["keep"]["number"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in by)


def test_dedup_keeps_columns_and_one_row_a_text(spark):
    docs = messy(spark)
    out = exact_dedup(docs)
    assert out.schema == docs.schema
    texts = [norm(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({norm(r[1]) for r in messy_rows()})


def test_empty(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert exact_dedup(empty(spark)).count() == 0
