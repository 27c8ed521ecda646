"""Every registered query of this subpackage on the smallest tables, against its SQL, the library it must equal, or plain code."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from loomgrid.llm import langid
from loomgrid.llm import queries as Q

from test_queries import SF, TABLES, rows
from . import test_bpe, test_tokencount
from .test_models import brute_difference


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(tables):
    return dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_its_sql(spark, tables, name):
    got = Q.QUERIES[name](spark, SF)
    want = tables.execute(Q.ORACLE_SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_op3_equals_the_plain_network(spark, tables, documents):
    got = {r["doc_id"]: r for r in Q.op3_language_id(spark, SF).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in documents}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train_language_model(docs.where(docs.doc_id.isin([d for d in held if not held[d]])))
    assert got.keys() == documents.keys()
    for d, text in documents.items():
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        x, _ = langid.windows(raw, np.array([0, len(raw)]))
        letters = (x[:, : langid.LENGTH] > 1).sum(axis=1)
        p = (langid._softmax(np.maximum(net.pooled(x)[0], 0) @ net.out + net.bias) * letters[:, None]).sum(axis=0) / letters.sum()
        assert got[d]["held_out"] == held[d] and got[d]["lang_pred"] == net.labels[int(p.argmax())] and abs(got[d]["score"] - p.max()) < 1e-4


def test_op5_equals_the_library(spark, documents):
    got = {r["doc_id"]: r for r in Q.op5_bpe(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for d, text in documents.items():
        ids = test_bpe.REFERENCE.encode_ordinary(text or "")
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_op6_equals_brute_force(spark, tables, documents):
    target = {d for (d,) in tables.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    want = brute_difference(list(documents.items()), target)
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in Q.op6_lm_scoring(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9 for d in want)


def test_op10_equals_the_library(spark, documents):
    got = {r["doc_id"]: r["n_tokens"] for r in Q.op10_token_counts(spark, SF).collect()}
    assert got == {d: len(test_tokencount.REFERENCE.encode(t or "")) for d, t in documents.items()}


def test_op10_bears_an_empty_table_and_a_very_long_text(spark):
    import public_tokenizers as tokenizers

    path = tokenizers.path("piece_bpe_32k.model")
    long = "the thing ing " * 50_000 + "x" * 20_000
    df = spark.createDataFrame([(1, long, 3), (2, None, 4)], "doc_id long, text string, n_tokens long")
    from loomgrid.llm.tokencount import token_count

    out = {r["doc_id"]: r["count"] for r in df.withColumn("count", token_count("text", df, path)).collect()}
    assert out == {1: len(test_tokencount.REFERENCE.encode(long)), 2: 0}
    assert df.limit(0).withColumn("count", token_count("text", df, path)).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from loomgrid.llm import common

    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
