"""Joins by row identity, attribute, lookup and block."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table
from foreglass.functions import text as X, vectors as V
from foreglass.operators import nested as N, relational as R

register(
    "bind_columns",
    """select coalesce(d.doc_id, b.item_id) as row_id, d.lang, md5(b.text) as item
       from (select doc_id, lang from documents) d full join benchmark b on d.doc_id = b.item_id""",
)(
    lambda spark, sf: R.bind_columns(
        table(spark, sf, "documents").selectExpr("doc_id as row_id", "lang"),
        table(spark, sf, "benchmark").selectExpr("item_id as row_id", "md5(text) as item"),
    )
)

register(
    "attach_sentence_and_label",
    "select d.doc_id as row_id, n_chars, quality from documents d left join labels l on d.doc_id = l.doc_id",
)(
    lambda spark, sf: R.attach(
        table(spark, sf, "documents").selectExpr("doc_id as row_id", "n_chars"),
        table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id"),
        ["quality"],
    )
)


@register(
    "attach_model_outputs",
    """select d.doc_id as row_id, lang, case when l.doc_id is not null then (n_chars >= 400)::int end as "length Prediction",
              1 - toxic as "toxic Prediction"
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def attach_model_outputs(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")
    scored = docs.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id"), "row_id").selectExpr(
        "row_id", "int(n_chars >= 400) as length", "1 - toxic as toxic"
    )
    long = scored.unpivot("row_id", ["length", "toxic"], "model", "prediction")
    return R.attach_model_outputs(docs.select("row_id", "lang"), long, ["length", "toxic"])


register(
    "natural_join",
    """select n_nationkey as nationkey, s_suppkey, c.n from (select n_nationkey from nation)
       join (select s_suppkey, nullif(s_nationkey, 3) as k from supplier) on k is not distinct from nullif(n_nationkey, 3)
       join (select c_nationkey, count(*) as n from customer group by 1) c on c_nationkey = n_nationkey""",
)(
    lambda spark, sf: R.natural_join(
        R.natural_join(
            table(spark, sf, "nation").selectExpr("n_nationkey as nationkey", "nullif(n_nationkey, 3) as k"),
            table(spark, sf, "supplier").selectExpr("s_suppkey", "nullif(s_nationkey, 3) as k"),
        ),
        table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n")),
    ).drop("k")
)


@register(
    "trial_grid_similarity",
    rf"""with p as (select item_id, string_split_regex(lower(text), '\s+') as pw from benchmark order by item_id limit 3),
        o as (select doc_id, string_split_regex(lower(text), '\s+') as ow from documents order by doc_id limit 33)
        select item_id, doc_id, round(2.0 * len(list_intersect(list_distinct(pw), list_distinct(ow)))
            / (len(list_distinct(pw)) + len(list_distinct(ow))), 6) as word_dice
        from p cross join o""",
)
def trial_grid_similarity(spark, sf):
    """A trial of 3 x 33 rows; ``similar_strings`` and ``tfidf_indexed_matches`` compare whole tables."""
    left = table(spark, sf, "benchmark").select("item_id", X.whitespace_tokens("text").alias("pw"))
    right = table(spark, sf, "documents").select("doc_id", X.whitespace_tokens("text").alias("ow"))
    pairs = R.slot_pairs(left, right, "item_id", "doc_id", per_left=33, heads=3)
    return pairs.select("item_id", "doc_id", F.round(V.word_dice("pw", "ow"), 6).alias("word_dice"))


register(
    "attribute_pairs",
    """with s as (select s_suppkey, s_nationkey as nation, row_number() over (partition by s_nationkey
           order by s_suppkey) as slot from supplier)
       select c_custkey, nation, s_suppkey from customer join s on c_nationkey = nation where slot <= 3""",
)(
    lambda spark, sf: R.slot_pairs(
        table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey as nation"),
        table(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey as nation"),
        "c_custkey",
        "s_suppkey",
        per_left=3,
        key="nation",
    ).select("c_custkey", "nation", "s_suppkey")
)

register(
    "attribute_pair_means",
    """with l as (select label, embedding::double[] as x from embeddings where embedding[1] > 0),
            r as (select label, embedding::double[] as y from embeddings where embedding[1] <= 0)
       select label, count(*) as pairs, round(avg(list_cosine_similarity(x, y)), 6) as mean_cosine
       from l join r using (label) group by 1""",
)(
    lambda spark, sf: R.attribute_pair_means(
        table(spark, sf, "embeddings").filter("embedding[0] > 0"),
        table(spark, sf, "embeddings").filter("embedding[0] <= 0"),
        "label",
        "embedding",
    ).withColumn("mean_cosine", F.round("mean_cosine", 6))
)

register(
    "alignment",
    """select count(*) as rows, count(*) filter (where not same) as different, bool_and(same) as aligned
       from (select coalesce((l.doc_id = d.doc_id) and l.quality is not distinct from (d.n_chars > 200)::int, false) as same
             from labels l full join (select documents.* from documents semi join labels using (doc_id)) d
             on l.doc_id = d.doc_id)""",
)(
    lambda spark, sf: R.alignment(
        table(spark, sf, "labels").selectExpr("doc_id as row_id", "quality as label"),
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
        .selectExpr("doc_id as row_id", "int(n_chars > 200) as label"),
        ["label"],
    )
)

register(
    "not_yet_done",
    "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
)(
    lambda spark, sf: R.not_yet_done(
        table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"]
    )
)

register(
    "work_plan",
    """select s_suppkey as batch_id, domain, model,
              printf('Write sentences about %s for batch %d.', domain, s_suppkey) as prompt
       from supplier, (values ('finance'), ('health'), ('weather')) d(domain), (values ('m1'), ('m2')) m(model)""",
)(
    lambda spark, sf: R.work_plan(
        table(spark, sf, "supplier").selectExpr("s_suppkey as batch_id"),
        ["finance", "health", "weather"],
        ["m1", "m2"],
        "Write sentences about %s for batch %d.",
    )
)

register(
    "matched_arrays",
    """select o_custkey, string_agg(o_orderkey::varchar, '|' order by rank) as matches
       from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank
             from orders) where rank <= 3 group by 1""",
)(
    lambda spark, sf: R.matched_arrays(
        R.top_k(
            table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
            ["o_custkey"],
            [F.desc("o_totalprice"), "o_orderkey"],
            3,
        ),
        "o_custkey",
        "o_orderkey",
    ).select("o_custkey", F.array_join(F.transform("matches", lambda m: m.cast("string")), "|").alias("matches"))
)


# ---- JSON of any depth ------------------------------------------------------------------


def order_records(spark, sf):
    """Orders as JSON; every other one has its priority two levels down, in a list."""
    buyers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    nation = F.struct(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("number")).alias("nation")).alias("customer")
    flat = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), nation))
    deep = F.to_json(F.struct(F.array(F.struct(F.col("o_orderpriority").alias("priority"))).alias("extra"), nation))
    return rows.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, flat).otherwise(deep).alias("record"))


@register(
    "json_search",
    """select o_orderkey, case when o_orderkey % 2 = 0 then '$.priority' else '$.extra[0].priority' end as path, o_orderpriority as value
         from orders where contains(o_orderpriority, '1')
       union all select o_orderkey, '$.customer.nation.name', n_name from orders join customer on o_custkey = c_custkey
         join nation on c_nationkey = n_nationkey where contains(n_name, '1')""",
)
def json_search(spark, sf):
    """Values that hold a word, wherever they stand in a record, with their paths."""
    return N.json_search(order_records(spark, sf), "o_orderkey", "record", "1")


@register(
    "json_leaves",
    """select o_orderkey, unnest([case when o_orderkey % 2 = 0 then '$.priority' else '$.extra[0].priority' end,
         '$.customer.nation.name', '$.customer.nation.number']) as path, unnest(['STRING', 'STRING', 'BIGINT']) as kind,
         unnest([o_orderpriority, n_name, n_nationkey::varchar]) as value
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
)
def json_leaves(spark, sf):
    """All values of the records with path and type."""
    return N.json_leaves(order_records(spark, sf), "o_orderkey", "record")
