import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreglass.functions import text as X
from foreglass.operators import features as T, retrieve as G

WORDS = [f"w{i}" for i in range(30)]


def texts(n, seed, common="the"):
    """Every text holds one common word many times; some texts are copies."""
    rnd = random.Random(seed)
    made = [" ".join([common] * rnd.randrange(1, 6) + rnd.choices(WORDS, k=rnd.randrange(1, 12))) for _ in range(n)]
    return made + made[: n // 4]


def tables(spark, docs, asks, tokens=X.whitespace_tokens):
    d = spark.createDataFrame(list(enumerate(docs)), "row_id bigint, text string").repartition(3, "row_id")
    q = spark.createDataFrame(list(enumerate(asks)), "query_id bigint, text string")
    return T.counted_terms(d, "row_id", tokens("text")), T.counted_terms(q, "query_id", tokens("text"))


def ranked(scores, k):
    rows = {}
    for (q, d), s in scores.items():
        if round(s, 6) > 0:
            rows.setdefault(q, []).append((-round(s, 6), d))
    return {q: [(d, -s) for s, d in sorted(hits)[:k]] for q, hits in rows.items()}


def collected(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.score))
    return got


def assert_same(got, want):
    assert {q: [d for d, _ in hits] for q, hits in got.items()} == {q: [d for d, _ in hits] for q, hits in want.items()}
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1.1e-6)


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_bm25_against_brute_force(spark, block):
    docs, asks = texts(40, 1), texts(9, 2)
    corpus, queries = tables(spark, docs, asks)
    bags = [Counter(d.split()) for d in docs]
    df = Counter(t for b in bags for t in b)
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    average = sum(map(lambda b: sum(b.values()), bags)) / len(bags)
    scores = {}
    for q, ask in enumerate(asks):
        for d, bag in enumerate(bags):
            size = sum(bag.values())
            parts = [idf[t] * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * size / average)) for t in ask.split() if bag[t]]
            if parts:
                scores[(q, d)] = sum(parts)
    assert_same(collected(G.bm25_top_k(corpus, queries, 5, block_postings=block)), ranked(scores, 5))


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_tfidf_against_brute_force(spark, block):
    docs, asks = texts(40, 3), texts(9, 4)
    corpus, queries = tables(spark, docs, asks, X.word_tokens)
    vocabulary = T.fit_vocabulary(corpus, len(docs), 20)
    bags = [Counter(d.split()) for d in docs]
    total, df = Counter(), Counter()
    for b in bags:
        total.update(b)
        df.update(b.keys())
    kept = sorted(total, key=lambda t: (-total[t], t))[:20]
    assert [r.term for r in vocabulary.orderBy(F.desc("cf"), "term").collect()] == kept
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}

    def unit(bag):
        v = {t: n * idf[t] for t, n in bag.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    d_vec, q_vec = [unit(b) for b in bags], [unit(Counter(a.split())) for a in asks]
    scores = {(q, d): sum(x * dv.get(t, 0) for t, x in qv.items()) for q, qv in enumerate(q_vec) for d, dv in enumerate(d_vec)}
    assert_same(collected(G.tfidf_top_k(corpus, queries, vocabulary, 6, block)), ranked(scores, 6))


def vector_tables(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(60, 5))
    vectors[7] = 0
    vectors[20] = vectors[21]
    keys = ["a" if i % 3 else "b" for i in range(60)]
    asks = rnd.normal(size=(6, 5))
    corpus = spark.createDataFrame(
        [(i, v.tolist(), keys[i]) for i, v in enumerate(vectors)], "row_id bigint, vector array<double>, k string"
    ).repartition(3, "row_id")
    queries = spark.createDataFrame(
        [(i, v.tolist(), "a" if i % 2 else "b") for i, v in enumerate(asks)], "query_id bigint, vector array<double>, k string"
    )
    return vectors, keys, asks, corpus, queries


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size else 0.0


@pytest.mark.parametrize("block", [2_000_000, 9])
def test_vector_search(spark, block):
    vectors, keys, asks, corpus, queries = vector_tables(spark)
    got = collected(G.vector_top_k(corpus, queries, 4, block_elements=block))
    keyed = collected(G.vector_top_k(corpus, queries, 4, key="k", block_elements=block))
    near = collected(G.vector_top_k(corpus, queries, 4, metric="l2", block_elements=block))
    for q, ask in enumerate(asks):
        order = sorted((-round(cosine(v, ask), 6), i) for i, v in enumerate(vectors))
        assert got[q] == [(i, -s) for s, i in order[:4]]
        own = [(s, i) for s, i in order if keys[i] == ("a" if q % 2 else "b")]
        assert keyed[q] == [(i, -s) for s, i in own[:4]]
        apart = sorted((round(float(((v - ask) ** 2).sum()), 6), i) for i, v in enumerate(vectors))
        assert [i for i, _ in near[q]] == [i for _, i in apart[:4]]
    with pytest.raises(ValueError):
        G.vector_top_k(corpus, queries, 4, metric="dot")


def test_diversified_picks(spark):
    vectors, _, asks, corpus, queries = vector_tables(spark)
    got = {}
    for r in G.diversified(corpus, queries, 3, fetch_k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    for q, ask in enumerate(asks):
        pool = [i for _, i in sorted((-round(cosine(v, ask), 6), i) for i, v in enumerate(vectors))[:6]]
        picked = [pool[0]]
        while len(picked) < 3:
            rest = [i for i in pool if i not in picked]
            value = lambda i: 0.5 * cosine(vectors[i], ask) - 0.5 * max(cosine(vectors[i], vectors[j]) for j in picked)  # noqa: B023,E731
            picked.append(max(rest, key=lambda i: (round(value(i), 6), -pool.index(i))))
        assert got[q] == picked


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query_id bigint, row_id bigint, score double, rank int")
    b = spark.createDataFrame([(1, 11, 7.0, 1)], "query_id bigint, row_id bigint, score double, rank int")
    assert {r.row_id: r.score for r in G.joined_hits(a, b).collect()} == {10: 0.9, 11: 7.0}
    fused = {r.row_id: r.score for r in G.fused_ranks(a, b).collect()}
    assert fused[11] == pytest.approx(1 / 62 + 1 / 61) and fused[10] == pytest.approx(1 / 61)


def test_empty_queries(spark):
    corpus, queries = tables(spark, ["a b"], [""])
    assert G.bm25_top_k(corpus, queries, 3).count() == 0


def test_pooled_vectors(spark):
    docs = spark.createDataFrame([(1, "up up down x"), (2, "zzz"), (3, "the")], "d bigint, t string")
    words = spark.createDataFrame([("up", [1.0, 0.0]), ("down", [0.0, 3.0]), ("the", [9.0, 9.0])], "word string, vector array<double>")
    counted = T.counted_terms(docs, "d", X.whitespace_tokens("t"))
    got = {r.d: r.vector for r in T.pooled_vectors(counted, "d", words, 2, skip=["the"]).collect()}
    assert got[1] == pytest.approx([2 / 3, 1.0]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


def test_keyword_score(spark):
    df = spark.createDataFrame([("profit rose in may",), ("",)], "t string")
    score = T.keyword_score(X.whitespace_tokens("t"), ["profit", "rose", "in", "gone"], {"profit": 8, "rose": 5})
    got = [r[0] for r in df.select(score).collect()]
    assert got == [pytest.approx(-(64 + 25) / 4), 0.0]


# --- index in blocks


@pytest.mark.parametrize("block_rows, k", [(1, 3), (4, 5), (64, 2)])
def test_block_index_equals_scoring_everything(spark, block_rows, k):
    import random

    from foreglass.operators import block_index as B

    rnd = random.Random(block_rows)
    docs = [(f"d{i:03d}", " ".join(rnd.choice("abcdefghijklmnop") * 2 for _ in range(rnd.choice([0, 1, 5, 30])))) for i in range(150)]
    asks = [(f"q{i}", " ".join(rnd.choice("abcdefghijklmnopz") * 2 for _ in range(rnd.choice([0, 1, 3, 8])))) for i in range(25)]
    corpus = T.term_index(spark.createDataFrame(docs, "row_id string, text string"), "row_id", X.whitespace_tokens("text"))
    queries = T.term_index(spark.createDataFrame(asks, "query_id string, text string"), "query_id", X.whitespace_tokens("text"))
    words = T.fit_vocabulary(corpus, len(docs), 12)
    found = B.tfidf_search(B.tfidf_index(corpus, words, block_rows), queries, words, k)
    assert collected(found) == collected(G.tfidf_top_k(corpus, queries, words, k))
    made = B.bm25_index(corpus, block_rows=block_rows)
    assert collected(B.bm25_search(made, queries, k)) == collected(G.bm25_top_k(corpus, queries, k))
    reads = B.bm25_search(made, queries, k, count_reads=True).collect()
    assert all(r["read"] <= r["blocks"] == made.index.n_blocks for r in reads)


def test_block_index_skips_blocks(spark):
    from foreglass.operators import block_index as B

    docs = [(i, f"t{i % 20} " * 3 + "common " * (i % 3)) for i in range(400)]
    corpus = T.term_index(spark.createDataFrame(docs, "row_id long, text string"), "row_id", X.whitespace_tokens("text"))
    queries = T.term_index(spark.createDataFrame([(1, "t3 common"), (2, "t7")], "query_id long, text string"), "query_id", X.whitespace_tokens("text"))
    made = B.bm25_index(corpus, block_rows=10)
    reads = {r["query_id"]: r["read"] for r in B.bm25_search(made, queries, 4, count_reads=True).collect()}
    assert reads[2] <= 8 and reads[1] < made.index.n_blocks / 2
    none = B.bm25_search(made, queries.limit(0), 4)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "row_id", "score"]


def test_diversified_takes_ids_of_any_type(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.1]), ("c", [0.0, 1.0])], "row_id string, vector array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.2])], "query_id string, vector array<double>")
    assert [(r.query_id, r.row_id) for r in G.diversified(corpus, queries, 2, fetch_k=3, relevance=0.3).orderBy("rank").collect()] == [("q", "b"), ("q", "c")]


ODD_TEXTS = [None, "", " \t\n", "  Two  two TWO\x0b", "\x1c x \x85 x", "İstanbul ﬁ ﬁ\r\nÇa ça", "a " * 400 + "b", "ends with blanks  "]


def test_words_are_counted_in_tasks_as_in_rows(spark):
    texts = spark.createDataFrame(list(enumerate(ODD_TEXTS * 3)), "row_id bigint, text string").repartition(2, "row_id")
    want = {r.row_id: [tuple(t) for t in r.terms] for r in T.counted_terms(texts, "row_id", X.whitespace_tokens("text")).collect()}
    lowered = texts.select(F.lower("text").alias("text"), "row_id")
    counted = lowered.mapInArrow(lambda batches: T.word_counts(batches, "text"), "row_id long, terms array<struct<term string, n long>>")
    assert {r.row_id: [tuple(t) for t in r.terms] for r in counted.collect()} == want


@pytest.mark.parametrize("block_rows", [3, 64])
def test_index_of_texts_equals_scoring_everything(spark, block_rows):
    from foreglass.operators import block_index as B

    docs, asks = texts(60, 5) + ODD_TEXTS + ["w1"], texts(9, 6) + ["two x ça", "gone", ""]
    corpus, queries = tables(spark, docs, asks)
    rows = spark.createDataFrame(list(enumerate(docs)), "row_id bigint, text string").repartition(3, "row_id")
    made = B.bm25_text_index(rows, block_rows=block_rows)
    assert collected(B.bm25_search(made, queries, 4)) == collected(G.bm25_top_k(corpus, queries, 4))
    df = Counter(t.term for r in corpus.collect() for t in r.terms)
    assert {r.term: r.df for r in B._document_counts(made.index).collect()} == df
    none = B.bm25_text_index(rows.limit(0))
    assert none.index.n_blocks == 0 and B.bm25_search(none, queries, 4).count() == 0


def test_index_needs_no_list_expressions_and_few_blocks_in_memory(spark, monkeypatch):
    """Those took most of the time, and Spark read up to 4096 blocks at once."""
    import pyarrow.parquet as pq

    from foreglass.operators import block_index as B

    plans, plain = {}, B.written_once

    def watched(df, name, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name, **options)

    monkeypatch.setattr(B, "written_once", watched)
    corpus, queries = tables(spark, texts(400, 7), texts(2, 8))
    corpus = corpus.localCheckpoint()
    made = B.bm25_index(corpus, block_rows=1)
    assert B.bm25_search(made, queries, 3).count() == 6
    assert plans and not [name for name, plan in plans.items() if "lambdafunction" in plan]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.index.blocks.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == made.index.n_blocks == 500 and max(groups) <= B.BLOCKS_AT_ONCE


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from foreglass.functions import text as X
from foreglass.operators import block_index as B, features as T
from foreglass.session import local_session
spark = local_session("alone", 2)
texts = spark.createDataFrame([(1, "up and down"), (2, "up"), (3, "left")], "row_id bigint, text string")
asked = T.counted_terms(texts.filter("row_id = 1").withColumnRenamed("row_id", "query_id"), "query_id", X.whitespace_tokens("text"))
made = B.bm25_index(T.counted_terms(texts, "row_id", X.whitespace_tokens("text")))
print("found", B.bm25_search(made, asked, 1).first()["row_id"])
"""


def test_index_is_searched_where_workers_lack_the_package(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", ALONE, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 1" in run.stdout, run.stderr[-2000:]
