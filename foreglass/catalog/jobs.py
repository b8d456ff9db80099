"""Composed jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table, text_table
from foreglass.catalog.learning import GRID_MODELS as ALL_MODELS, scored_facts
from foreglass.catalog.profiles import VOTES_SQL, replies
from foreglass.catalog.ratings import FULL_MODELS, KAPPA, LONG, MODELS, RATED, rated
from foreglass.catalog.replies import ACCOUNTS
from foreglass.catalog.retrieval import bm25_sql, corpus, word_vectors
from foreglass.catalog.runs import METRICS, runs
from foreglass.catalog.texts import CUES, SENTENCES, SQL_WORDS
from foreglass.functions import text as X
from foreglass.operators import experiments as XP, profile as PR, relational as R
from foreglass.plans import jobs as J
from foreglass.scale import scratch_path
from foreglass.sources import scans as SC

FUTURE = rf"""s as ({SENTENCES}), w as (select doc_id, sentence_no, unnest({SQL_WORDS.format('lower(sentence)')}) as word from s),
   f as (select doc_id, sentence_no, max((word in ('was', 'is', 'est', 'ist'))::int) as is_future from w group by all)"""

register(
    "future_sentence_table",
    f"""with {FUTURE} select doc_id, sentence_no::int as sentence_no, sentence from s join f using (doc_id, sentence_no)
        where is_future = 1""",
)(
    lambda spark, sf: J.future_sentences(text_table(spark, sf), "doc_id", "text", CUES)
    .filter("is_future = 1")
    .select("doc_id", "sentence_no", "sentence")
)

register(
    "future_sentence_shares",
    f"""with {FUTURE} select is_future, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1) as percent
        from f group by 1""",
)(
    lambda spark, sf: PR.class_distribution(
        J.future_sentences(text_table(spark, sf), "doc_id", "text", CUES), "is_future"
    )
)

register(
    "cleaned_text",
    rf"""with a as (select page_id, regexp_replace(regexp_replace(lower(html), '<[^\n]*?>', ' ', 'g'), 'http\S+', '', 'g') as t
          from pages),
        b as (select page_id, array_to_string(list_transform({SQL_WORDS.format('t')}, lambda w: w), ' ') as t from a)
        select page_id, regexp_replace(regexp_replace(regexp_replace(t, '[^a-zA-Z\s]', ' ', 'g'), '[^a-zA-Z0-9$%\s]', ' ', 'g'),
          ' +', ' ', 'g') as text from b""",
)(
    lambda spark, sf: text_table(spark, sf, "pages", "page_id").select("page_id", J.clean_text(F.col("html")).alias("text"))
)

register(
    "agreement_study",
    f"""with {RATED}, v as (select label, (length_rule + source_rule + toxic_rule >= 2)::int as three,
          toxic_rule as one from rated),
        l as (select label as actual, 'three' as model, three as predicted from v union all select label, 'one', one from v)
        select model, round(avg((actual = predicted)::int), 6) as accuracy,
          round(count(*) filter (where actual = 1 and predicted = 1) / count(*) filter (where predicted = 1), 6) as precision,
          round(count(*) filter (where actual = 1 and predicted = 1) / count(*) filter (where actual = 1), 6) as recall,
          round(2 * count(*) filter (where actual = 1 and predicted = 1) /
            (count(*) filter (where actual = 1) + count(*) filter (where predicted = 1)), 6) as f1 from l group by 1""",
)(
    lambda spark, sf: XP.rounded(
        J.agreement_study(rated(spark, sf), "row_id", "label", {"three": FULL_MODELS, "one": ["toxic_rule"]}),
        ["accuracy", "precision", "recall", "f1"],
    )
)


@register(
    "averaged_experiments",
    """with r as (select case l_linenumber % 4 when 0 then 'seeds_imbalanced' when 1 then 'seeds_oversampled'
          when 2 then 'seeds_undersampled' else 'seeds_plain' end as experiment, year(l_shipdate) as seed,
          l_returnflag || l_linestatus as model, avg(l_quantity / 50) as accuracy from lineitem group by 1, 2, 3),
        m as (select experiment, model, avg(accuracy) as accuracy from r group by 1, 2)
        select model, round(avg(accuracy), 6) as accuracy_mean_across_datasets,
          round(stddev_pop(accuracy), 6) as accuracy_std_across_datasets,
          round(max(accuracy) - min(accuracy), 6) as accuracy_margin from m group by 1""",
)
def averaged_experiments(spark, sf):
    margins = J.average_experiments(runs(spark, sf).withColumn("version", F.lit(0)), METRICS)[1]
    columns = ["accuracy_mean_across_datasets", "accuracy_std_across_datasets", "accuracy_margin"]
    return XP.rounded(margins.select("model", *columns), columns)


QUERY_TEXT = """(select item_id, 'x ' || regexp_replace(text, '[^a-zA-Z ]', '', 'g') as qt from benchmark)"""
CERTIFIED = f"""{bm25_sql("qt", QUERY_TEXT)}, certified as (select query_id, row_id, rank, score
    from best join labels on row_id = doc_id where rank <= 33 and quality = 1)"""


def _certified(spark, sf):
    """Properties come as replies of whole statements; the judge's replies are made from the given labels."""
    plain = F.regexp_replace("text", "[^a-zA-Z ]", "")
    said = F.format_string("{0: [], 1: [], 2: ['x'], 3: [], 4: ['%s']}", plain)
    statements = table(spark, sf, "benchmark").select("item_id", said.alias("reply"))
    reports = corpus(spark, sf, X.whitespace_tokens)
    judged = table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.format_string('Verdict: {"label": %d, "reasoning": "toxic %d"}', "quality", "toxic").alias("reply"),
    )
    return J.certified_pairs(statements, "item_id", "reply", reports, lambda hits: hits.join(judged, "row_id"))


register("certified_pairs", f"with {CERTIFIED} select * from certified")(_certified)
register(
    "certified_lists", f"with {CERTIFIED} select query_id, list(row_id order by rank) as reports from certified group by 1"
)(lambda spark, sf: J.certified_lists(_certified(spark, sf)))


@register(
    "future_sentence_runs",
    f"""with {FUTURE} select doc_id, sentence_no::int as sentence_no, sentence, is_future from s join f using (doc_id, sentence_no)""",
)
def future_sentence_runs(spark, sf):
    """Two parts of the texts run apart, one of them twice; the newest run of each is stacked."""
    folder = scratch_path(spark, "tense")
    docs = text_table(spark, sf)
    for prefix, part in (("english", docs.filter("lang = 'en'")), ("others", docs.filter("lang <> 'en'")), ("others", docs.filter("lang <> 'en'"))):
        record = J.tense_run(part, "doc_id", "text", CUES, folder, prefix).first()
        assert record["n_rows"] == record["n_positive"] + record["n_negative"]
    return J.latest_runs(spark, folder, "doc_id bigint, sentence_no int, sentence string, is_future int")


@register(
    "text_experiment",
    f"""select m.model, n as test_rows, true as scored from (select sum(floor(n * 0.2 + 0.5))::bigint as n
        from (select count(*) as n from labels join documents using (doc_id) where lang = 'en' and quality is not null group by quality)),
        (values {', '.join(f"('{m}')" for m in ALL_MODELS)}) m(model)""",
)
def text_experiment(spark, sf):
    """Texts of one dataset, shuffled, as pooled word vectors, split, and all registered models trained together and scored."""
    rows = text_table(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", "quality", (F.col("lang") != "en").cast("int").alias("author_type")
    )
    docs = corpus(spark, sf, X.whitespace_tokens).withColumnRenamed("row_id", "doc_id")
    vectors = word_vectors(spark, sf, docs)
    outputs, metrics = J.text_experiment(rows, "doc_id", "text", "quality", "generated", vectors, 64, ALL_MODELS, 42, trees=10)
    return scored_facts(outputs, metrics, ["experiment", "seed"], ALL_MODELS).select("model", "test_rows", "scored")


@register("agreement_of_two_tables", f"with {LONG}, {KAPPA} select model_1, model_2, round((po - pe) / (1 - pe), 6) as kappa from k")
def agreement_of_two_tables(spark, sf):
    """Ratings from two tables, checked for equal rows, bound and compared by Cohen's and Fleiss' kappa."""
    both = rated(spark, sf)
    left, right = both.select("row_id", "label", "length_rule", "source_rule"), both.select("row_id", "label", "toxic_rule", "lang_rule")
    votes, pairs, _ = J.full_agreement_study(left, right, "row_id", "label", MODELS, {"three": FULL_MODELS})
    assert votes.first()["model"] == "three"
    return pairs.select("model_1", "model_2", F.round("kappa", 6).alias("kappa"))


@register(
    "labelled_posts",
    f"""with {VOTES_SQL}, posts as (select o_orderkey as sentence_id, c_name as username, o_orderpriority as text, o_orderdate,
          row_number() over (partition by c_name, o_orderpriority order by o_orderdate, o_orderkey) as n
          from orders join customer on o_custkey = c_custkey where c_nationkey <> 5)
        select posts.sentence_id, username, text, n_votes, case when n_votes = 1 then 'None as all are different labels'
          else label end as majority_label from posts join m using (sentence_id) where n = 1""",
)
def labelled_posts(spark, sf):
    """Posts given twice, with account strings: once each, first per author and text, with the judges' verdict."""
    accounts = table(spark, sf, "customer").selectExpr("c_custkey as o_custkey", ACCOUNTS)
    posts = table(spark, sf, "orders").join(accounts, "o_custkey").selectExpr(
        "o_orderkey as sentence_id", "account", "o_orderpriority as text", "o_orderdate"
    )
    twice = posts.unionAll(posts)
    found = J.labelled_posts(
        replies(spark, sf), ["sentence_id"], "reply", ["vote_pos"], twice, "account", "text", ["o_orderdate", "sentence_id"]
    )
    return found.select("sentence_id", "username", "text", "n_votes", "majority_label")


@register(
    "training_table_from_files",
    """select s_name as sentence, 1 as sentence_label, 0 as author_type, 'generated' as dataset from supplier where s_nationkey >= 3
       union all select p_name, 0, 0, 'generated' from part
       union all select c_name, (c_mktsegment = 'BUILDING')::int, 1, 'annotated' from customer""",
)
def training_table_from_files(spark, sf):
    """Generated sentences from batch files, annotated ones from a file with its own separator."""
    root = scratch_path(spark, "batches")
    suppliers = table(spark, sf, "supplier").selectExpr("s_name as sentence", "concat('batch_', s_nationkey, '-forecast') as batch")
    suppliers.write.partitionBy("batch").option("header", True).csv(root)
    generated = SC.read_batches(spark, root, "forecast", "sentence string", 3, layout="batch=batch_*-{kind}/*.csv")
    path = scratch_path(spark, "annotated")
    table(spark, sf, "customer").select(F.concat_ws("@", "c_name", "c_mktsegment")).write.text(path)
    annotated = SC.split_at_last(SC.read_lines(spark, path), "@", ("sentence", "label"))
    observed = table(spark, sf, "part").selectExpr("p_name as sentence")
    return J.training_table(generated.select("sentence"), observed, annotated, "BUILDING")


@register(
    "label_missing_and_save",
    """select doc_id, coalesce(case when lang <> 'de' then lang end, 'q' || quality) as label
       from documents left join labels using (doc_id)""",
)
def label_missing_and_save(spark, sf):
    """Labels filled in, saved as the next version and read back."""
    path = J.label_missing_and_save(
        table(spark, sf, "documents").selectExpr("doc_id", "nullif(lang, 'de') as label"),
        table(spark, sf, "labels").selectExpr("doc_id", "concat('q', quality) as label"),
        "doc_id",
        "label",
        scratch_path(spark, "labelled"),
        "labels",
    )
    return spark.read.parquet(path)


register("required_columns", "select doc_id, lang from documents")(
    lambda spark, sf: R.require_columns(table(spark, sf, "documents"), ["doc_id", "lang"]).select("doc_id", "lang")
)


register(
    "judged_posts",
    f"""with {VOTES_SQL} select o_orderkey as sentence_id, o_orderpriority, n_votes,
        case when n_votes = 1 then 'None as all are different labels' else label end as majority_label
        from m join orders on o_orderkey = sentence_id""",
)(
    lambda spark, sf: J.judged_posts(
        replies(spark, sf),
        ["sentence_id"],
        "reply",
        ["vote_pos"],
        table(spark, sf, "orders").selectExpr("o_orderkey as sentence_id", "o_orderpriority"),
    )
)

register(
    "training_table",
    """select text as sentence, 1 as sentence_label, 0 as author_type, 'generated' as dataset from benchmark
       union all select text, 0, 0, 'generated' from conversations
       union all select text, (lang = 'en')::int, 1, 'annotated' from documents""",
)(
    lambda spark, sf: J.training_table(
        table(spark, sf, "benchmark").selectExpr("text as sentence"),
        table(spark, sf, "conversations").selectExpr("text as sentence"),
        table(spark, sf, "documents").selectExpr("text as sentence", "lang as label"),
        "en",
    )
)

register(
    "label_missing",
    """select doc_id, coalesce(case when lang <> 'de' then lang end, 'q' || quality) as label
       from documents left join labels using (doc_id)""",
)(
    lambda spark, sf: J.label_missing(
        table(spark, sf, "documents").selectExpr("doc_id", "nullif(lang, 'de') as label"),
        table(spark, sf, "labels").selectExpr("doc_id", "concat('q', quality) as label"),
        "doc_id",
        "label",
    )
)

