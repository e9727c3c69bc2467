"""The registered queries, digests included: against SQL where there is some, else against brute force."""

import hashlib
import math
import os

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quernstone.llm import bpe, token_counts
from quernstone.llm import queries as corpus

DATA = "/root/testdata/sf0.001"
SQL = corpus.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def run(spark, name):
    return corpus.queries()[name](spark, DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, duck, name):
    df = run(spark, name)
    columns = sorted(df.columns)
    assert sorted(duck.sql(SQL[name]).columns) == columns
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(want, key=str)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_token_counts(spark):
    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    trie, split = token_counts.Trie(ranks), regex.compile(P.PATTERN)

    def brute(word):
        b = word.encode()
        score, best = [0.0] + [None] * len(b), [(0, 0)] + [None] * len(b)
        for j in range(1, len(b) + 1):
            ends = [(score[i] + trie.pieces[b[i:j]][0], (best[i][0] + trie.pieces[b[i:j]][1], best[i][1] + 1)) for i in range(max(0, j - trie.longest), j) if b[i:j] in trie.pieces]
            score[j], best[j] = math.log(math.fsum(math.exp(x) for x, _ in ends)), min(x for _, x in ends)
        return best[-1][1], score[-1]

    known = {}
    got = {r.doc_id: r for r in run(spark, "op1_token_counts").collect()}
    docs = texts(spark)
    assert set(got) == set(docs)
    for i in sorted(docs)[:60]:
        words = split.findall(docs[i])
        each = [known.setdefault(w, brute(w)) for w in words]
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(words), sum(n for n, _ in each))
        assert got[i].score == pytest.approx(sum(s for _, s in each))


def test_byte_bpe(spark):
    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts(spark).items():
        ids = tik.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op5_byte_bpe").collect()} == want


def test_nearest_neighbours(spark, monkeypatch):
    from quernstone.llm import neighbours

    asked, learn = [], neighbours.learn
    monkeypatch.setattr(neighbours, "learn", lambda x, parts, *a: asked.append(parts) or learn(x, parts, *a))
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.embedding and None not in r.embedding}
    rows = {i: x for i, x in rows.items() if np.isfinite(x).all() and x.any()}
    ids, hit, got = sorted(rows), 0, {}
    x = np.stack([rows[i] for i in ids])
    for r in run(spark, "op4_nearest_neighbours").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert asked and asked[0] > 1 and set(got) == {i for i in ids if i % 100 == 0}
    for q, found in got.items():
        d = dict(zip(ids, np.sqrt(((x - rows[q]) ** 2).sum(1)).tolist(), strict=True))
        want = sorted((d[i], i) for i in ids if i != q)[:10]
        assert [n for n, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(d[v]) for _, s, v in found)
        hit += len({i for _, i in want} & {v for _, _, v in found})
    assert hit >= 0.9 * 10 * len(got)


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = {r.doc_id: r for r in run(spark, "op6_toxicity").collect()}
    assert set(got) == set(texts(spark)) and all(r.toxic == (r.p_toxic >= 0.5) and 0 <= r.p_quality <= 1 for r in got.values())
    assert sum(got[i].toxic == bool(t) for i, t in labels.items() if i in got) >= 0.95 * len(labels)


def test_language_id(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in run(spark, "op9_language_id").collect()}
    assert set(got) == set(rows)
    held = [i for i in got if got[i].held_out and rows[i].lang and got[i].lang_pred != "und"]
    assert len(held) > 20 and sum(got[i].lang_pred == rows[i].lang for i in held) >= 0.9 * len(held)


def test_files_of_the_library_do_not_import_the_operators():
    import re

    import quernstone

    top = os.path.dirname(quernstone.__file__)
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, name)).read()), name


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quernstone.llm import common

    class Elsewhere:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://h:7077", "getConf": staticmethod(dict)})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Elsewhere())
    assert common.shared_folder(spark)


def test_likely_rows(spark):
    from quernstone.llm.common import likely

    rows = spark.range(-5, 40_000).withColumn("x", F.lit("x"))
    wanted = spark.range(0, 40_000, 37).selectExpr("id as w")
    n = wanted.count()
    found = likely(rows, "id", wanted, "w", n)
    assert found.columns == rows.columns
    ids = {r.id for r in found.collect()}
    assert {r.w for r in wanted.collect()} <= ids and len(ids) < n + 40_000 // 8
    few = {r.id for r in likely(rows, "id", wanted, "w", n, 1 << 15).collect()}
    assert {r.w for r in wanted.collect()} <= few
    assert likely(rows, "id", wanted.limit(0), "w", 0).count() == 0
