"""Sparse and dense retrieval: ``benchmark`` texts as queries on ``documents``, vectors on ``embeddings``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from foreglass.catalog import register, table, text_table
from foreglass.catalog.texts import SQL_WORDS
from foreglass.functions import text as X, vectors as V
from foreglass.operators import block_index as B, features as T, relational as R, retrieve as G, vector_index as VI

MAX_FEATURES = 2000


def counted(spark, sf, tokens=X.word_tokens):
    return T.term_index(text_table(spark, sf), "doc_id", tokens("text"))


def corpus(spark, sf, tokens=X.word_tokens):
    return counted(spark, sf, tokens).withColumnRenamed("doc_id", "row_id")


def asked(spark, sf, tokens=X.word_tokens):
    terms = T.counted_terms(table(spark, sf, "benchmark"), "item_id", tokens("text"))
    return terms.withColumnRenamed("item_id", "query_id")


def vocabulary(spark, sf, docs):
    return T.fit_vocabulary(docs, table(spark, sf, "documents").count(), MAX_FEATURES)


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TF = rf"""tf as (select doc_id, term, count(*) as n from (select doc_id, unnest({TOKENS}) as term from documents)
    group by all)"""
VOCAB = f"""vocab as (select term, sum(n) as cf, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf
    from tf group by term order by cf desc, term limit {MAX_FEATURES})"""
TFIDF = f"""{TF}, {VOCAB}, raw as (select doc_id, term, n * idf as w from tf join vocab using (term)),
    weights as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw),
    qtf as (select item_id, term, count(*) as n from (select item_id, unnest({TOKENS}) as term from benchmark) group by all),
    qraw as (select item_id, term, n * idf as w from qtf join vocab using (term)),
    qw as (select item_id, term, w / sqrt(sum(w * w) over (partition by item_id)) as weight from qraw),
    hits as (select item_id as query_id, doc_id as row_id, round(sum(q.weight * d.weight), 6) as score
      from qw q join weights d using (term) group by all having round(sum(q.weight * d.weight), 6) > 0),
    best as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from hits)"""


@register("tfidf_best_matches", f"with {TFIDF} select query_id, rank, row_id, score from best where rank <= 5")
def tfidf_best_matches(spark, sf):
    docs = corpus(spark, sf)
    return G.tfidf_top_k(docs, asked(spark, sf), vocabulary(spark, sf, docs), 5)


register(
    "tfidf_weights", f"with {TFIDF} select doc_id, term, round(weight, 6) as weight from weights"
)(
    lambda spark, sf: (
        lambda docs: T.tfidf_weights(docs, "doc_id", vocabulary(spark, sf, docs)).withColumn(
            "weight", F.round("weight", 6)
        )
    )(counted(spark, sf))
)

register("fitted_vocabulary", f"with {TF}, {VOCAB} select term, cf::bigint as cf, round(idf, 6) as idf from vocab")(
    lambda spark, sf: vocabulary(spark, sf, counted(spark, sf)).select("term", "cf", F.round("idf", 6).alias("idf"))
)

WORDS_TF = f"""tf as (select doc_id, term, count(*) as n from (select doc_id, unnest({SQL_WORDS.format('lower(text)')})
    as term from documents) group by all), len as (select doc_id, sum(n) as len from tf group by 1)"""
BM25 = f"""{WORDS_TF}, qtf as (select item_id, term, count(*) as n from (select item_id,
      unnest({SQL_WORDS.format('lower({q})')}) as term from {{benchmark}}) group by all),
    raw as (select term, ln((select count(*) from documents) - count(*) + 0.5) - ln(count(*) + 0.5) as raw
      from tf group by term),
    idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
    hits as (select q.item_id as query_id, t.doc_id as row_id, round(sum(q.n * idf * t.n * 2.5 /
        (t.n + 1.5 * (0.25 + 0.75 * len / (select sum(len) / (select count(*) from documents) from len)))), 6) as score
      from qtf q join tf t using (term) join idf using (term) join len on t.doc_id = len.doc_id group by all),
    best as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from hits
      where score > 0)"""


def bm25_sql(text="text", source="benchmark"):
    return BM25.replace("{q}", text).replace("{benchmark}", source)


@register(
    "bm25_best_matches",
    f"with {bm25_sql()} select query_id, rank, row_id, score from best where rank <= 10",
)
def bm25_best_matches(spark, sf):
    return G.bm25_top_k(corpus(spark, sf, X.whitespace_tokens), asked(spark, sf, X.whitespace_tokens), 10)


KEYWORDS = {"the": 3, "of": 2, "la": 4, "die": 2.5, "und": 1.5}
register(
    "keyword_boosted_scores",
    f"""with w as (select doc_id, {SQL_WORDS.format('lower(text)')} as ws from documents)
        select doc_id, round(case when len(ws) = 0 then 0 else (
          {' + '.join(f"(len(list_filter(ws, lambda x: x = '{t}')) / len(ws) * (case when list_contains(ws, '{t}') then 0 else ln(1e6) end - {KEYWORDS.get(t, 0)}) * {KEYWORDS.get(t, 1)})" for t in ('the', 'of', 'der', 'la'))}
          ) end, 6) as score from w""",
)(
    lambda spark, sf: table(spark, sf, "documents")
    .select("doc_id", X.whitespace_tokens("text").alias("w"))
    .select("doc_id", F.round(T.keyword_score(F.col("w"), ["the", "of", "der", "la"], KEYWORDS), 6).alias("score"))
)

register(
    "collection_tfidf",
    f"""with {WORDS_TF}, idf as (select term, ln((select count(*) from documents) / (sum(n) + 1)) as idf from tf group by 1)
        select doc_id, term, round(n / len * idf, 6) as weight from tf join len using (doc_id) join idf using (term)""",
)(
    lambda spark, sf: T.collection_tfidf(
        counted(spark, sf, X.whitespace_tokens), "doc_id", table(spark, sf, "documents").count()
    ).withColumn("weight", F.round("weight", 6))
)

POOLED = f"""{TF}, top as (select term, row_number() over (order by sum(n) desc, term) - 1 as vec_id from tf group by term),
    wv as (select term, embedding from top join embeddings using (vec_id)),
    dims as (select doc_id, i, sum(n * embedding[i]::double) / sum(n) as v
      from tf join wv using (term), range(1, 65) r(i) where term not in ('the', 'of', 'la') group by all)"""


def word_vectors(spark, sf, docs):
    """The most frequent words get the given vectors, in order."""
    from foreglass.scale import positions

    vectors = table(spark, sf, "embeddings")
    words = T.term_statistics(docs).orderBy(F.desc("cf"), "term").limit(vectors.count())
    ranked = positions(words.withColumn("_down", -F.col("cf")), [], ["_down", "term"], "_n")
    return ranked.select(F.col("term").alias("word"), (F.col("_n") - 1).alias("vec_id")).join(vectors, "vec_id").select(
        "word", F.col("embedding").alias("vector")
    )


register(
    "pooled_vectors",
    f"""with {POOLED} select d.doc_id, round(coalesce(max(v) filter (where i = 1), 0), 6) as first_dim,
        round(coalesce(sum(v), 0), 6) as total from documents d left join dims on d.doc_id = dims.doc_id group by 1""",
)(
    lambda spark, sf: (
        lambda docs: T.pooled_vectors(
            docs, "doc_id", word_vectors(spark, sf, docs), 64, skip=["the", "of", "la"]
        ).select(
            "doc_id",
            F.round(F.get("vector", F.lit(0)), 6).alias("first_dim"),
            F.round(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b), 6).alias("total"),
        )
    )(counted(spark, sf))
)

# ---- vectors ---------------------------------------------------------------


def vectors(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("vec_id as row_id", "embedding as vector", "label")


def centroids(spark, sf):
    """Mean vector per label: a partial aggregate, so a frequent label is no hot spot."""
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, sf).withColumn("v", array_to_vector(F.col("vector").cast("array<double>")))
    means = rows.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(F.col("label").cast("bigint").alias("query_id"), vector_to_array("m").alias("vector"), "label")


NEIGHBOURS = """pairs as (select a.vec_id, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a
    join embeddings b on b.vec_id = a.vec_id + 1)"""


def neighbours(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    shifted = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return rows.join(shifted, "vec_id")


register(
    "row_cosine",
    f"""with {NEIGHBOURS} select vec_id, round(list_cosine_similarity(x, y), 6) as cosine,
        round(list_inner_product(x, y), 6) as dot,
        round(2 * list_inner_product(x, y) / (list_inner_product(x, x) + list_inner_product(y, y)), 6) as dice from pairs""",
)(
    lambda spark, sf: neighbours(spark, sf).select(
        "vec_id",
        F.round(V.cosine("x", "y"), 6).alias("cosine"),
        F.round(V.dot("x", "y"), 6).alias("dot"),
        F.round(V.vector_dice("x", "y"), 6).alias("dice"),
    )
)

register(
    "row_correlations",
    f"""with {NEIGHBOURS}, e as (select vec_id, unnest(x) as a, unnest(y) as b from pairs),
        r as (select vec_id, a, b, rank() over (partition by vec_id order by a) + (count(*) over (partition by vec_id, a) - 1) / 2 as ra,
              rank() over (partition by vec_id order by b) + (count(*) over (partition by vec_id, b) - 1) / 2 as rb from e)
        select vec_id, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from r group by 1""",
)(
    lambda spark, sf: neighbours(spark, sf).select(
        "vec_id", F.round(V.pearson("x", "y"), 6).alias("pearson"), F.round(V.spearman("x", "y"), 6).alias("spearman")
    )
)

CENTROIDS = """dims as (select label, i, avg(embedding[i]::double) as v from embeddings, range(1, 65) r(i) group by all),
    cent as (select label, list(v order by i) as c from dims group by 1),
    e as (select vec_id, label, embedding::double[] as x from embeddings)"""

register(
    "vector_best_matches",
    f"""with {CENTROIDS}, s as (select c.label::bigint as query_id, vec_id as row_id,
          round(list_cosine_similarity(c, x), 6) as score from cent c, e),
        b as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from s)
        select query_id, rank, row_id, score from b where rank <= 33""",
)(
    lambda spark, sf: G.vector_top_k(vectors(spark, sf), centroids(spark, sf), 33).select(
        "query_id", "rank", "row_id", "score"
    )
)

register(
    "vector_nearest_by_distance",
    f"""with {CENTROIDS}, s as (select c.label::bigint as query_id, vec_id as row_id,
          round(list_distance(c, x) ** 2, 6) as score from cent c, e),
        b as (select *, row_number() over (partition by query_id order by score, row_id) as rank from s)
        select query_id, rank, row_id, score from b where rank <= 5""",
)(
    lambda spark, sf: G.vector_top_k(vectors(spark, sf), centroids(spark, sf), 5, metric="l2").select(
        "query_id", "rank", "row_id", "score"
    )
)

register(
    "vector_matches_by_key",
    f"""with {CENTROIDS}, s as (select c.label::bigint as query_id, vec_id as row_id,
          round(list_cosine_similarity(c, x), 6) as score from cent c join e on c.label = e.label),
        b as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from s)
        select query_id, rank, row_id, score from b where rank <= 4""",
)(
    lambda spark, sf: G.vector_top_k(vectors(spark, sf), centroids(spark, sf), 4, key="label").select(
        "query_id", "rank", "row_id", "score"
    )
)

register(
    "diversified_matches",
    f"""with {CENTROIDS}, s as (select c.label::bigint as query_id, vec_id, x,
          round(list_cosine_similarity(c, x), 6) as score from cent c, e),
        b as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s
              qualify n <= 5),
        p1 as (select * from b where n = 1),
        s2 as (select b.*, row_number() over (partition by b.query_id order by
                 round(0.5 * b.score - 0.5 * list_cosine_similarity(b.x, p1.x), 9) desc, b.n) as m
               from b join p1 using (query_id) where b.n > 1),
        p2 as (select * from s2 where m = 1),
        s3 as (select b.*, row_number() over (partition by b.query_id order by
                 round(0.5 * b.score - 0.5 * greatest(list_cosine_similarity(b.x, p1.x),
                   list_cosine_similarity(b.x, p2.x)), 9) desc, b.n) as m
               from b join p1 using (query_id) join p2 using (query_id) where b.n > 1 and b.n <> p2.n)
        select query_id, 1 as rank, vec_id as row_id, score from p1
        union all select query_id, 2, vec_id, score from p2
        union all select query_id, 3, vec_id, score from s3 where m = 1""",
)(
    lambda spark, sf: G.diversified(vectors(spark, sf), centroids(spark, sf), 3, fetch_k=5).select(
        "query_id", "rank", "row_id", "score"
    )
)


def hybrid_lists(spark, sf):
    """Sparse hits on the texts and dense hits on the vectors of the same ids."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    own = vectors(spark, sf).withColumnRenamed("row_id", "query_id").join(items, "query_id")
    sparse = G.bm25_top_k(corpus(spark, sf, X.whitespace_tokens), asked(spark, sf, X.whitespace_tokens), 10)
    dense = G.vector_top_k(vectors(spark, sf), own, 10)
    return sparse, dense


HYBRID = bm25_sql() + """, ds as (select q.vec_id as query_id, d.vec_id as row_id,
      round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) as score
      from embeddings q join benchmark on q.vec_id = item_id, embeddings d),
    db as (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from ds),
    both_lists as (select query_id, row_id, score, rank from best where rank <= 10
      union all select query_id, row_id, score, rank from db where rank <= 10)"""

register(
    "hybrid_joined_hits",
    f"with {HYBRID} select query_id, row_id, max(score) as score from both_lists group by all",
)(lambda spark, sf: G.joined_hits(*hybrid_lists(spark, sf)))

register(
    "hybrid_fused_ranks",
    f"with {HYBRID} select query_id, row_id, round(sum(1 / (60.0 + rank)), 6) as score from both_lists group by all",
)(lambda spark, sf: G.fused_ranks(*hybrid_lists(spark, sf)).withColumn("score", F.round("score", 6)))

PARTS = r"""(select item_id, array_to_string(p, ' ') as qt from (select item_id,
    list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
    lambda x: x <> '') as p from benchmark))"""


@register(
    "statement_report_matches",
    f"""with {bm25_sql('qt', PARTS)} select query_id, string_agg(row_id::varchar, '|' order by rank) as matches
        from best where rank <= 33 group by 1""",
)
def statement_report_matches(spark, sf):
    """Query text from all pieces of a statement; the 33 best reports of each as one array."""
    pieces = table(spark, sf, "benchmark").select("item_id", X.sentence_pieces("text").alias("p"))
    texts = pieces.select(
        F.col("item_id").alias("query_id"),
        F.array_join("p", " ").alias("text"),
    )
    queries = T.counted_terms(texts, "query_id", X.whitespace_tokens("text"))
    hits = G.bm25_top_k(corpus(spark, sf, X.whitespace_tokens), queries, 33)
    arrays = R.matched_arrays(hits, "query_id", "row_id")
    return arrays.select(
        "query_id", F.array_join(F.transform("matches", lambda m: m.cast("string")), "|").alias("matches")
    )


register(
    "word_set_overlap",
    f"""with p as (select item_id, list_distinct({SQL_WORDS.format('lower(b.text)')}) as x,
          list_distinct({SQL_WORDS.format('lower(d.text)')}) as y from benchmark b join documents d on item_id = doc_id)
        select item_id, len(list_intersect(x, y)) as n_common, array_to_string(list_sort(list_intersect(x, y)), '|') as common,
          round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) as dice,
          round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) as jaccard from p""",
)(
    lambda spark, sf: table(spark, sf, "benchmark")
    .select("item_id", X.whitespace_tokens("text").alias("x"))
    .join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), X.whitespace_tokens("text").alias("y")),
        "item_id",
    )
    .select(
        "item_id",
        F.size(V.common_words("x", "y")).alias("n_common"),
        F.array_join(F.sort_array(V.common_words("x", "y")), "|").alias("common"),
        F.round(V.word_dice("x", "y"), 6).alias("dice"),
        F.round(V.word_jaccard("x", "y"), 6).alias("jaccard"),
    )
)

register(
    "embedding_plane",
    "select vec_id, round(embedding[1]::double, 6) as x, round(embedding[2]::double, 6) as y, label from embeddings",
)(
    lambda spark, sf: table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"),
        F.round(F.get("embedding", F.lit(1)).cast("double"), 6).alias("y"),
        "label",
    )
)

register(
    "document_records",
    "select text, lang, source, doc_id::varchar as doc_id, true as has_id from documents",
)(
    lambda spark, sf: T.build_documents(table(spark, sf, "documents").drop("n_chars"), "text").select(
        "text",
        F.col("metadata")["lang"].alias("lang"),
        F.col("metadata")["source"].alias("source"),
        F.col("metadata")["doc_id"].alias("doc_id"),
        (F.length("id") == 64).alias("has_id"),
    )
)


# ---- the same answers from an index in blocks -------------------------------------------


@register("tfidf_indexed_matches", f"with {TFIDF} select query_id, rank, row_id, score from best where rank <= 5")
def tfidf_indexed_matches(spark, sf):
    docs = corpus(spark, sf)
    words = vocabulary(spark, sf, docs)
    return B.tfidf_search(B.tfidf_index(docs, words), asked(spark, sf), words, 5)


@register("bm25_indexed_matches", f"with {bm25_sql()} select query_id, rank, row_id, score from best where rank <= 10")
def bm25_indexed_matches(spark, sf):
    texts = text_table(spark, sf).select(F.col("doc_id").alias("row_id"), "text")
    return B.bm25_search(B.bm25_text_index(texts), asked(spark, sf, X.whitespace_tokens), 10)


@register(
    "index_reads",
    f"""with {TFIDF} select query_id, true as within, true as pruned from qw join (select item_id as query_id, item_id from benchmark) b
        using (item_id) group by query_id""",
)
def index_reads(spark, sf):
    """Blocks that each query scored: never more than there are, and over all queries fewer."""
    docs = corpus(spark, sf)
    words = vocabulary(spark, sf, docs)
    reads = B.tfidf_search(B.tfidf_index(docs, words, 16), asked(spark, sf), words, 5, count_reads=True)
    whole = reads.agg((F.sum("read") < 0.9 * F.sum("blocks")).alias("pruned"))
    return reads.select("query_id", (F.col("read") <= F.col("blocks")).alias("within"), F.lit(whole.first()["pruned"]).alias("pruned"))


# ---- the same answers from cells around centres -------------------------------------------


def every_fiftieth(spark, sf):
    return vectors(spark, sf).filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")


def nearest_sql(score, k, order="desc", extra="true"):
    """The ``k`` best vectors for every vector whose id is divisible by 50, against all."""
    return f"""with e as (select vec_id, label, embedding::double[] as x from embeddings),
        s as (select a.vec_id as query_id, b.vec_id as row_id, round({score}, 6) as score from e a join e b on a.vec_id % 50 = 0 and {extra}),
        best as (select *, row_number() over (partition by query_id order by score {order}, row_id) as rank from s)
        select query_id, rank, row_id, score from best where rank <= {k}"""


HIT = ["query_id", "rank", "row_id", "score"]


@register("vector_cell_matches", nearest_sql("list_cosine_similarity(a.x, b.x)", 20))
def vector_cell_matches(spark, sf):
    return VI.search(VI.build_index(vectors(spark, sf)), every_fiftieth(spark, sf), 20).select(HIT)


@register("vector_cell_nearest", nearest_sql("list_distance(a.x, b.x) ** 2", 10, order=""))
def vector_cell_nearest(spark, sf):
    return VI.search(VI.build_index(vectors(spark, sf), "l2"), every_fiftieth(spark, sf), 10).select(HIT)


@register("vector_cell_matches_by_key", nearest_sql("list_cosine_similarity(a.x, b.x)", 10, extra="a.label = b.label"))
def vector_cell_matches_by_key(spark, sf):
    return VI.search(VI.build_index(vectors(spark, sf), key="label"), every_fiftieth(spark, sf), 10).select(HIT)


@register(
    "vector_cell_reads",
    """select vec_id as query_id, true as within, (select count(*) from embeddings) as "rows" from embeddings where vec_id % 50 = 0""",
)
def vector_cell_reads(spark, sf):
    """Vectors that each query was compared with: at least its hits, at most all there are."""
    reads = VI.search(VI.build_index(vectors(spark, sf)), every_fiftieth(spark, sf), 20, count_reads=True)
    return reads.select("query_id", F.col("scored").between(20, F.col("rows")).alias("within"), "rows")
