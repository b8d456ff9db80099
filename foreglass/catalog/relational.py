"""Projections, filters and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table
from foreglass.functions import replies as P, text as X
from foreglass.operators import relational as R
from foreglass.scale import top_k

register("drop_columns", "select c_custkey, c_name, c_acctbal from customer")(
    lambda spark, sf: R.drop_columns(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])
)

register("drop_columns_like", "select p_partkey, p_size, p_retailprice from part")(
    lambda spark, sf: R.drop_columns_like(table(spark, sf, "part"), "^p_(name|brand|type)")
)

register("select_and_rename", "select doc_id as row_id, lang as domain, source as api_name from documents")(
    lambda spark, sf: R.select_and_rename(
        table(spark, sf, "documents"),
        ["doc_id", "lang", "source"],
        {"doc_id": "row_id", "lang": "domain", "source": "api_name"},
    )
)

register(
    "constant_columns",
    "select doc_id, 1 as author_type, 'posts' as site, 'documents' as dataset_name from documents",
)(
    lambda spark, sf: R.constant_columns(
        table(spark, sf, "documents").select("doc_id"), {"author_type": 1, "site": "posts", "dataset_name": "documents"}
    )
)

register("filter_equal", "select event_id, user_id, value from events where event_type = 'purchase'")(
    lambda spark, sf: R.equals(table(spark, sf, "events"), "event_type", "purchase").select(
        "event_id", "user_id", "value"
    )
)

register("filter_differs", "select event_id, event_type from events where event_type is distinct from 'error'")(
    lambda spark, sf: R.differs(table(spark, sf, "events"), "event_type", "error").select("event_id", "event_type")
)

AUTHORED = """(select doc_id, lang, case when source in ('src1', 'src2', 'src3') then 1
   when source <> 'src4' then 0 end as author_type from documents)"""


def authored(spark, sf):
    kind = F.when(F.col("source").isin("src1", "src2", "src3"), 1).when(F.col("source") != "src4", 0)
    return table(spark, sf, "documents").select("doc_id", "lang", kind.alias("author_type"))


register("named_dataset", f"select doc_id, lang, author_type from {AUTHORED} where author_type = 1")(
    lambda spark, sf: R.named_dataset(authored(spark, sf), "human")
)

register("filter_contains", "select p_partkey, p_name from part where contains(lower(p_name), 'ring')")(
    lambda spark, sf: table(spark, sf, "part")
    .filter(X.contains_text("p_name", "RING"))
    .select("p_partkey", "p_name")
)

register("drop_missing", f"select * from {AUTHORED} where author_type is not null")(
    lambda spark, sf: authored(spark, sf).dropna(subset=["author_type"])
)

register("keep_missing", f"select * from {AUTHORED} where author_type is null")(
    lambda spark, sf: R.keep_missing(authored(spark, sf), "author_type")
)

register("columns_differ", "select doc_id, quality, toxic from labels where quality is distinct from toxic")(
    lambda spark, sf: R.columns_differ(table(spark, sf, "labels"), "quality", "toxic")
)

register(
    "label_to_int",
    "select o_orderkey, (o_orderstatus is not distinct from 'F')::int as int_label from orders",
)(
    lambda spark, sf: R.label_to_int(table(spark, sf, "orders"), "o_orderstatus", "F").select(
        "o_orderkey", "int_label"
    )
)

ENTITIES = """(select p_partkey, case p_size % 6 when 0 then 'LOC_' || p_size when 1 then 'FAC' when 2 then 'WORK_OF_ART'
     when 3 then 'CARDINAL' when 4 then 'LOC' else 'ORG' end as ner_label,
   case p_partkey % 7 when 0 then 'Q' || (p_size % 4 + 1) || ' of 2031' when 1 then p_size || ' March 2030'
     when 2 then '-' || p_size || '°C' when 3 then p_size || '°F to ' || p_size || '°F' when 4 then 'Weather Underground'
     when 5 then 'Quarter ' || (p_size % 4) else p_name end as term from part)"""


def entities(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey",
        """case p_size % 6 when 0 then concat('LOC_', p_size) when 1 then 'FAC' when 2 then 'WORK_OF_ART'
           when 3 then 'CARDINAL' when 4 then 'LOC' else 'ORG' end as ner_label""",
        """case p_partkey % 7 when 0 then concat('Q', p_size % 4 + 1, ' of 2031') when 1 then concat(p_size, ' March 2030')
           when 2 then concat('-', p_size, '°C') when 3 then concat(p_size, '°F to ', p_size, '°F')
           when 4 then 'Weather Underground' when 5 then concat('Quarter ', p_size % 4) else p_name end as term""",
    )


register(
    "corrected_entities",
    rf"""select p_partkey, term, case when ner_label = 'LOC' or ner_label like 'LOC\_%' escape '\' then 'GPE'
        when ner_label = 'FAC' then 'PERSON'
        when ner_label = 'WORK_OF_ART' and regexp_matches(term, '^(Q\d of \d{{4}}|Quarter \d|\d Q\d)') then 'DATE'
        when ner_label = 'WORK_OF_ART' and term in ('Weather Underground', 'The Weather Channel') then 'ORG'
        when ner_label = 'CARDINAL' and regexp_matches(term, '^\d{{1,2}} [a-zA-Z]+ \d{{4}}') then 'DATE'
        when ner_label = 'CARDINAL' and regexp_matches(term, '^-?\d+°[CF]') then 'TEMPERATURE'
        else ner_label end as ner_label from {ENTITIES}""",
)(
    lambda spark, sf: entities(spark, sf).select(
        "p_partkey", "term", R.corrected_entity_label("ner_label", "term").alias("ner_label")
    )
)

register(
    "presence_flags",
    f"""select doc_id, (author_type is not null)::int as author_type, (l is not null)::int as l,
               (author_type is not null)::int + (l is not null)::int as n_present
        from (select doc_id, author_type, nullif(lang, 'en') as l from {AUTHORED})""",
)(
    lambda spark, sf: R.presence_flags(
        authored(spark, sf).select("doc_id", "author_type", F.nullif("lang", F.lit("en")).alias("l")),
        ["author_type", "l"],
    )
)

PRIORITIES = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3}
register(
    "ordinal_codes",
    """select o_orderkey, case o_orderpriority when '5-LOW' then 0 when '4-NOT SPECIFIED' then 1
         when '3-MEDIUM' then 2 when '2-HIGH' then 3 end as code from orders""",
)(
    lambda spark, sf: table(spark, sf, "orders").select(
        "o_orderkey", R.ordinal_code("o_orderpriority", PRIORITIES).alias("code")
    )
)

register(
    "blank_or_other",
    """select conv_id, turn, case when r = ' ' then ' ' else 'O' end as tag
       from (select conv_id, turn, case role when 'user' then ' ' else role end as r from conversations)""",
)(
    lambda spark, sf: table(spark, sf, "conversations")
    .select("conv_id", "turn", F.when(F.col("role") == "user", " ").otherwise(F.col("role")).alias("r"))
    .select("conv_id", "turn", R.blank_or_other("r").alias("tag"))
)

register(
    "int_or_default",
    "select p_partkey, coalesce(try_cast(split_part(p_name, ' ', 2) as int), -1) as a, "
    "coalesce(try_cast(replace(p_brand, 'Brand#', '') as int), -1) as b from part",
)(
    lambda spark, sf: table(spark, sf, "part").select(
        "p_partkey",
        P.int_or(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("a"),
        P.int_or(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("b"),
    )
)

register("first_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")(
    lambda spark, sf: R.first_rows(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25
    )
)

register("row_range", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from events order by event_id limit 100 offset 50")(
    lambda spark, sf: R.row_range(
        table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")),
        ["event_id"],
        50,
        150,
    )
)

register("last_rows", "select event_id, event_type from events order by event_id desc limit 40")(
    lambda spark, sf: R.last_rows(table(spark, sf, "events").select("event_id", "event_type"), ["event_id"], 40)
)

register(
    "claim_filter",
    """select doc_id, text from documents join labels using (doc_id) where quality = 1 and toxic = 0""",
)(
    lambda spark, sf: R.equals(R.equals(table(spark, sf, "labels"), "quality", 1), "toxic", 0)
    .join(table(spark, sf, "documents"), "doc_id")
    .select("doc_id", "text")
)

# ---- order and top-k -------------------------------------------------------

register(
    "sorted_scores",
    "select event_type, round(avg(value), 6) as score from events group by 1 order by score desc, event_type",
)(
    lambda spark, sf: table(spark, sf, "events")
    .groupBy("event_type")
    .agg(F.round(F.avg("value"), 6).alias("score"))
    .orderBy(F.desc("score"), "event_type")
)

SCORES = """(select vec_id, model, score from (select vec_id, round(embedding[1]::double, 6) as first_dim,
   round(embedding[2]::double, 6) as second_dim, round(embedding[3]::double, 6) as third_dim from embeddings)
   unpivot (score for model in (first_dim, second_dim, third_dim)))"""
SCORE_COLUMNS = ["first_dim", "second_dim", "third_dim"]


def score_table(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        *[F.round(F.get("embedding", F.lit(i)).cast("double"), 6).alias(n) for i, n in enumerate(SCORE_COLUMNS)],
    )


register(
    "top_per_model",
    f"""select vec_id, model, score, rank::int as rank from (select *, row_number() over (partition by model
        order by score desc, vec_id) as rank from {SCORES}) where rank <= 10""",
)(
    lambda spark, sf: top_k(
        score_table(spark, sf).unpivot("vec_id", SCORE_COLUMNS, "model", "score"),
        ["model"],
        [F.desc("score"), "vec_id"],
        10,
    )
)

register("top_over_all", f"select * from {SCORES} order by score desc, vec_id, model limit 15")(
    lambda spark, sf: R.first_rows(
        score_table(spark, sf).unpivot("vec_id", SCORE_COLUMNS, "model", "score"),
        [F.desc("score"), "vec_id", "model"],
        15,
    )
)

register("newest_links", "select distinct url from pages order by url desc limit 20")(
    lambda spark, sf: table(spark, sf, "pages").select("url").distinct().orderBy(F.desc("url")).limit(20)
)

register(
    "seeded_shuffle",
    "select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as position from documents",
)(lambda spark, sf: R.shuffle_positions(table(spark, sf, "documents").select("doc_id"), "doc_id"))

# ---- set operations --------------------------------------------------------

register(
    "union_by_name",
    """select c_custkey as id, c_name as name, c_mktsegment as segment from customer
       union all select s_suppkey, s_name, null from supplier""",
)(
    lambda spark, sf: R.union_by_name(
        table(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as name", "c_mktsegment as segment"),
        table(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_name as name"),
    )
)

register("drop_duplicate_rows", "select distinct text, lang from documents")(
    lambda spark, sf: R.drop_duplicate_rows(table(spark, sf, "documents").select("text", "lang"))
)

register(
    "keep_first_per_text",
    """select doc_id, lang, source from (select *, row_number() over (partition by text, lang order by doc_id) as n
       from documents) where n = 1""",
)(
    lambda spark, sf: R.keep_first(
        # equal texts have equal digests, so whole texts need not be shuffled
        table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest")),
        ["digest", "lang"],
        ["doc_id"],
    ).drop("digest")
)

register(
    "keep_first_user_event",
    """select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type
       order by event_id) as n from events) where n = 1""",
)(
    lambda spark, sf: R.keep_first(
        table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]
    )
)

register(
    "common_columns_union",
    """select doc_id as id, text, 'documents' as dataset from documents
       union all select item_id, text, 'benchmark' from benchmark""",
)(
    lambda spark, sf: R.combine_sources(
        [
            table(spark, sf, "documents").withColumnRenamed("doc_id", "id").withColumn("dataset", F.lit("documents")),
            table(spark, sf, "benchmark").withColumnRenamed("item_id", "id").withColumn("dataset", F.lit("benchmark")),
        ],
        ["id", "text", "dataset"],
    )
)

register("distinct_values", "select distinct lang, source from documents")(
    lambda spark, sf: table(spark, sf, "documents").select("lang", "source").distinct()
)

register(
    "any_duplicates",
    """select sum(n)::bigint as rows, count(*) as distinct_values, max(n) > 1 as has_duplicates
       from (select text, count(*) as n from documents group by text)""",
)(
    lambda spark, sf: R.any_duplicates(
        table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest")), "digest"
    )
)
