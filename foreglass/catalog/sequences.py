"""Ordered work on ``events`` (per user), ``documents`` (per text) and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table, text_table
from foreglass.catalog.texts import SQL_WORDS
from foreglass.functions import text as X
from foreglass.operators import sequence as S, tokens as K


def events(spark, sf):
    return table(spark, sf, "events")


STEPS = """steps as (select event_id, user_id, event_type, coalesce(lag(event_type) over (partition by user_id
    order by ts, event_id), '<s>') as previous from events)"""

register("previous_state", f"with {STEPS} select event_id, event_type, previous from steps")(
    lambda spark, sf: S.previous_value(
        events(spark, sf).select("event_id", "user_id", "ts", "event_type"),
        ["user_id"],
        ["ts", "event_id"],
        "event_type",
        "<s>",
    ).select("event_id", "event_type", "previous")
)

PAIRS = f"""w as (select doc_id, {SQL_WORDS.format('lower(text)')} as ws from documents),
    pairs as (select doc_id, (i - 1)::int as pos, ws[i] as word_1, ws[i + 1] as word_2
              from (select doc_id, ws, unnest(range(1, len(ws))) as i from w))"""


def words_of_texts(spark, sf):
    return text_table(spark, sf).select("doc_id", X.whitespace_tokens("text").alias("ws"))


def pairs(spark, sf):
    return S.word_pairs(words_of_texts(spark, sf), ["doc_id"], "ws")


register("word_pairs", f"with {PAIRS} select * from pairs")(pairs)

register(
    "word_pair_counts",
    f"with {PAIRS} select doc_id, pos, word_1, word_2, count(*) over (partition by word_1, word_2) as n_pair from pairs",
)(lambda spark, sf: S.with_pair_counts(words_of_texts(spark, sf), ["doc_id"], "ws"))

register(
    "word_pair_probabilities",
    f"""with {PAIRS}, c as (select word_1, word_2, count(*) as n_pair from pairs group by all)
        select word_1, word_2, n_pair, round(n_pair / sum(n_pair) over (partition by word_1), 6) as p from c""",
)(lambda spark, sf: S.pair_probabilities(pairs(spark, sf)).withColumn("p", F.round("p", 6)))

LABELLED = f"""t as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from
     (select doc_id, {SQL_WORDS.format('lower(text)')} as ws from documents)),
   labelled as (select doc_id, pos::int as pos, word, case when length(word) > 7 then 'LONG'
     when length(word) > 3 then 'MID' else 'SHORT' end as label from t)"""


def word_label(word):
    size = F.length(word)
    return F.when(size > 7, "LONG").when(size > 3, "MID").otherwise("SHORT")


def labelled(spark, sf):
    return K.word_rows(text_table(spark, sf), ["doc_id"], "text").withColumn("label", word_label("word"))


def labelled_arrays(spark, sf):
    words = text_table(spark, sf).select("doc_id", X.whitespace_tokens("text").alias("words"))
    return words.withColumn("labels", F.transform("words", word_label))


register(
    "numbered_labels_per_document",
    f"""with {LABELLED} select doc_id, pos, label || '_' || row_number() over (partition by doc_id, label order by pos)
        as unique_label from labelled""",
)(
    lambda spark, sf: S.numbered_labels(labelled(spark, sf), "label", ["pos"], per=["doc_id"]).select(
        "doc_id", "pos", "unique_label"
    )
)

register(
    "numbered_labels_over_all",
    f"""with {LABELLED} select doc_id, pos, label || '_' || row_number() over (partition by label order by doc_id, pos)
        as unique_label from labelled""",
)(
    lambda spark, sf: S.numbered_labels_of_arrays(labelled_arrays(spark, sf), "doc_id", "labels")
)

WIDE = ["LONG_1", "LONG_2", "MID_1", "SHORT_1"]
register(
    "wide_labels",
    f"""with {LABELLED}, n as (select doc_id, word, label || '_' || row_number() over (partition by doc_id, label
          order by pos) as u from labelled)
        select d.doc_id, {', '.join(f'''max(word) filter (where u = '{w}') as "{w}"''' for w in WIDE)}
        from documents d left join n on d.doc_id = n.doc_id group by 1""",
)(
    lambda spark, sf: S.wide_labels_of_arrays(labelled_arrays(spark, sf), "doc_id", "words", "labels", WIDE)
)

register(
    "marker_rows_to_ids",
    """with l as (select source, doc_id * 100000 + generate_subscripts(ls, 1) - 1 as line, unnest(ls) as content
         from (select source, doc_id, string_split(text, chr(10)) as ls from documents))
       select source, line, sentence_no::bigint as sentence_no from (select *, sum((content like 'E%')::int) over
         (partition by source order by line) as sentence_no from l) where content not like 'E%'""",
)(
    lambda spark, sf: S.marker_rows_to_ids(
        table(spark, sf, "documents")
        .select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
        .select("source", (F.col("doc_id") * 100_000 + F.col("i")).alias("line"), "content"),
        "source",
        "line",
        F.col("content").startswith("E"),
    ).select("source", "line", "sentence_no")
)

register(
    "look_back_windows",
    """select event_id, round(x1, 6) as x1, round(x2, 6) as x2, round(x3, 6) as x3, y from
       (select event_id, lag(value, 3) over w as x1, lag(value, 2) over w as x2, lag(value, 1) over w as x3, value as y,
               row_number() over w as n from events window w as (partition by user_id order by ts, event_id)) where n > 3""",
)(
    lambda spark, sf: S.look_back_windows(
        events(spark, sf).select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", 3
    ).select(
        "event_id", *[F.round(F.get("x", F.lit(i)), 6).alias(f"x{i + 1}") for i in range(3)], "y"
    )
)

register(
    "tail_split",
    """select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) <= 5 as is_test
       from events""",
)(
    lambda spark, sf: S.tail_split(
        events(spark, sf).select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 5
    ).select("event_id", "is_test")
)

register(
    "first_per_group",
    """select vec_id, label from (select vec_id, label, row_number() over (partition by label order by vec_id) as n
       from embeddings) where n <= 7""",
)(
    lambda spark, sf: S.first_per_group(
        table(spark, sf, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 7
    )
)

register(
    "rebuilt_sentences",
    """with t as (select conv_id, string_split(string_agg(text, ' ' order by turn), '.') as ss
         from conversations group by 1)
       select conv_id, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as sentence_no from t""",
)(lambda spark, sf: S.rebuilt_sentences(table(spark, sf, "conversations"), "conv_id", ["turn"], "text"))

TRANSITIONS = f"""{STEPS}, tc as (select previous as from_state, event_type as to_state, count(*) as n from steps
    group by all), tp as (select *, n / sum(n) over (partition by from_state) as p from tc)"""


def transitions(spark, sf):
    return S.transition_counts(
        events(spark, sf).select("event_id", "user_id", "ts", "event_type"),
        ["user_id"],
        ["ts", "event_id"],
        "event_type",
    )


register("transition_counts", f"with {TRANSITIONS} select from_state, to_state, n, round(p, 6) as p from tp")(
    lambda spark, sf: transitions(spark, sf).withColumn("p", F.round("p", 6))
)

register(
    "chain_probability",
    f"""with {TRANSITIONS} select user_id, count(*) as steps, true as possible, round(sum(ln(p)), 6) as log_p
        from steps join tp on previous = from_state and event_type = to_state group by 1""",
)(
    lambda spark, sf: S.chain_log_probability(
        events(spark, sf).select("event_id", "user_id", "ts", "event_type"),
        ["user_id"],
        ["ts", "event_id"],
        "event_type",
        transitions(spark, sf),
    ).withColumn("log_p", F.round("log_p", 6))
)
