"""Splits, resampling, weights and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table
from foreglass.operators import sampling as S

register(
    "stratified_split",
    """select doc_id, quality, row_number() over (partition by quality order by md5('42:' || doc_id), doc_id)
         <= floor(count(*) over (partition by quality) * 0.2 + 0.5) as is_test from labels""",
)(
    lambda spark, sf: S.split_rows(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 0.2, 42, ["quality"]
    )
)

register(
    "stratified_split_two_labels",
    """select doc_id, row_number() over (partition by quality, toxic order by md5('7:' || doc_id), doc_id)
         <= floor(count(*) over (partition by quality, toxic) * 0.25 + 0.5) as is_test from labels""",
)(
    lambda spark, sf: S.split_rows(table(spark, sf, "labels"), "doc_id", 0.25, 7, ["quality", "toxic"]).select(
        "doc_id", "is_test"
    )
)

register(
    "plain_split",
    """select o_orderkey, row_number() over (order by md5('42:' || o_orderkey), o_orderkey)
         <= floor(count(*) over () * 0.2 + 0.5) as is_test from orders""",
)(lambda spark, sf: S.split_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey"))

register(
    "undersampled",
    """select doc_id, quality from labels qualify row_number() over (partition by quality
         order by md5('42:' || doc_id), doc_id) <= (select min(n) from (select count(*) as n from labels group by quality))""",
)(
    lambda spark, sf: S.resampled(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", "undersample"
    )
)

register(
    "oversampled",
    """with n as (select quality, count(*) as n from labels group by 1), h as (select max(n) as high from n),
       r as (select doc_id, quality, row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) as r from labels)
       select doc_id, quality, unnest(range(0, high // n + (r <= high % n)::int))::int as copy
       from r join n using (quality), h""",
)(
    lambda spark, sf: S.resampled(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", "oversample"
    )
)

register(
    "class_weights",
    """select vec_id, round((select count(*) from embeddings) /
         ((select count(distinct label) from embeddings) * count(*) over (partition by label)), 6) as weight from embeddings""",
)(
    lambda spark, sf: S.class_weights(table(spark, sf, "embeddings").select("vec_id", "label"), "label").select(
        "vec_id", F.round("weight", 6).alias("weight")
    )
)

register(
    "hash_folds",
    "select vec_id, (('0x' || left(md5('42:' || vec_id), 8))::bigint % 5)::int as fold from embeddings",
)(lambda spark, sf: S.folds(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 5))


@register(
    "standard_scaling",
    """select event_id, round((value - (select avg(value) from events)) / (select stddev_pop(value) from events), 6)
         as scaled, round(value, 6) as restored from events""",
)
def standard_scaling(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    parameters = S.scaling_parameters(events, ["value"])
    both = S.unscaled(S.scaled(events, parameters), parameters)
    return both.select(
        "event_id", F.round("value_scaled", 6).alias("scaled"), F.round("value_restored", 6).alias("restored")
    )
