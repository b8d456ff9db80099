"""Readers and writers: given tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from foreglass.catalog import register, table
from foreglass.functions import replies as P
from foreglass.scale import scratch_path
from foreglass.sources import ranges as N, scans as S, sinks as W

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@register("delimited_scan", "select * from customer")
def delimited_scan(spark, sf):
    path = scratch_path(spark, "delimited")
    table(spark, sf, "customer").write.csv(path, sep="\t", header=True)
    return S.read_table_file(spark, path, CUSTOMER)


@register("versioned_sink", "select * from supplier")
def versioned_sink(spark, sf):
    folder = scratch_path(spark, "versions")
    suppliers = table(spark, sf, "supplier")
    W.save_versioned(suppliers.limit(1), folder, "suppliers", "json")
    path = W.save_versioned(suppliers, folder, "suppliers", "json")
    assert path.endswith("suppliers-v2")
    return S.read_json_lines(spark, path, suppliers.schema)


@register("json_lines_scan", "select event_id, event_type, value from events")
def json_lines_scan(spark, sf):
    path = scratch_path(spark, "lines")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return S.read_json_lines(spark, path, "event_id bigint, event_type string, value double")


@register("json_array_scan", "select s_nationkey, count(*) as n, min(s_name) as first_name from supplier group by 1")
def json_array_scan(spark, sf):
    path = scratch_path(spark, "arrays")
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count("*").alias("n"), F.min("s_name").alias("first_name")
    )
    # one file per nation, each holding one JSON array
    rows.select("s_nationkey", F.to_json(F.array(F.struct(*rows.columns))).alias("value")).write.partitionBy(
        "s_nationkey"
    ).text(path)
    return S.read_json_array(spark, f"{path}/*/", "s_nationkey int, n bigint, first_name string")


BROKEN_UP = """select doc_id, source, md5(replace(replace(text, '. ', '.' || chr(10)), ' the ', ' "the", ')) as digest,
    length(text) as n from documents"""


def broken_up(spark, sf):
    """Texts with line breaks, quotes and separators inside."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit(" the "), F.lit(' "the", '))
    return table(spark, sf, "documents").select("doc_id", "source", text.alias("broken"), F.length("text").alias("n"))


def digested(rows):
    return rows.select("doc_id", "source", F.md5("broken").alias("digest"), "n")


@register("quoted_breaks_scan", BROKEN_UP)
def quoted_breaks_scan(spark, sf):
    """Quoted cells with line breaks, read by ranges of the files."""
    path = scratch_path(spark, "quoted")
    rows = broken_up(spark, sf)
    rows.write.csv(path, header=True, escape='"', emptyValue='""', lineSep="\n")
    return digested(N.read_csv_in_ranges(spark, path, rows.schema))


@register("json_array_ranges_scan", BROKEN_UP)
def json_array_ranges_scan(spark, sf):
    """Large JSON arrays, read by ranges of the files."""
    path = scratch_path(spark, "array-ranges")
    rows = broken_up(spark, sf)
    W.write_json_arrays(rows, path)
    return digested(N.read_json_array_in_ranges(spark, path, rows.schema))


LISTING = """(select 'runs/' || p_type || case when p_partkey % 3 = 0 then '-v' else '-' end || p_size ||
    case when p_partkey % 2 = 0 then '.csv' else '.json' end as path from part)"""


def listing(spark, sf):
    return table(spark, sf, "part").selectExpr(
        """concat('runs/', p_type, if(p_partkey % 3 = 0, '-v', '-'), p_size, if(p_partkey % 2 = 0, '.csv', '.json'))
           as path"""
    )


register(
    "latest_files",
    rf"""select prefix, extension, max(version) as version from (select
          regexp_extract(path, '([^/]*)-v?(\d+)\.([^.]+)$', 1) as prefix,
          regexp_extract(path, '([^/]*)-v?(\d+)\.([^.]+)$', 3) as extension,
          regexp_extract(path, '([^/]*)-v?(\d+)\.([^.]+)$', 2)::bigint as version from {LISTING}) group by all""",
)(lambda spark, sf: S.latest_files(listing(spark, sf)).drop("path"))

register(
    "next_file_numbers",
    rf"""select prefix, max(version) + 1 as next_version from (select
          regexp_extract(path, '([^/]*)-v?(\d+)\.([^.]+)$', 1) as prefix,
          regexp_extract(path, '([^/]*)-v?(\d+)\.([^.]+)$', 2)::bigint as version from {LISTING}) group by all""",
)(lambda spark, sf: S.next_numbers(listing(spark, sf)))

register(
    "latest_seed_folders",
    r"""select experiment, seed, max(v) as version, arg_max(folder, v) as folder from (
          select lower(p_type) || '_runs' as experiment, p_size % 45 as seed, p_partkey // 45 % 4 as v,
            'out/' || lower(p_type) || '_runs/seed' || (p_size % 45) ||
              case when p_partkey // 45 % 4 > 0 then '_v' || (p_partkey // 45 % 4) else '' end as folder from part)
        group by 1, 2""",
)(
    lambda spark, sf: S.latest_seed_folders(
        table(spark, sf, "part").selectExpr(
            """concat('out/', lower(p_type), '_runs/seed', p_size % 45,
               if(p_partkey div 45 % 4 > 0, concat('_v', p_partkey div 45 % 4), '')) as folder"""
        )
    )
)


@register("last_separator_scan", "select doc_id::varchar || '@' || source as sentence, lang as sentiment from documents")
def last_separator_scan(spark, sf):
    path = scratch_path(spark, "phrases")
    table(spark, sf, "documents").selectExpr("concat(doc_id, '@', source, '@', lang) as value").write.text(path)
    return S.split_at_last(S.read_lines(spark, path, "ISO-8859-1"), "@", ("sentence", "sentiment"))


@register(
    "tag_file_scan",
    """select c_custkey::varchar as index, c_name as word, c_mktsegment as tag from customer""",
)
def tag_file_scan(spark, sf):
    path = scratch_path(spark, "tags")
    customers = table(spark, sf, "customer")
    # a blank line after every sentence of ten words, and some malformed lines
    lines = customers.selectExpr(
        """explode(if(c_custkey % 10 = 9, array(concat_ws('\t', c_custkey, c_name, c_mktsegment), '', 'no tabs here'),
           array(concat_ws('\t', c_custkey, c_name, c_mktsegment)))) as value"""
    )
    lines.write.text(path)
    good, _ = S.read_tag_lines(spark, path)
    return good.filter("word is not null").select("index", "word", "tag")


@register("tag_file_bad_lines", "select content, count(*) as n from (select 'no tabs here' as content from customer where c_custkey % 10 = 9) group by 1")
def tag_file_bad_lines(spark, sf):
    path = scratch_path(spark, "tags")
    table(spark, sf, "customer").selectExpr(
        """explode(if(c_custkey % 10 = 9, array(concat_ws('\t', c_custkey, c_name, c_mktsegment), '', 'no tabs here'),
           array(concat_ws('\t', c_custkey, c_name, c_mktsegment)))) as value"""
    ).write.text(path)
    _, bad = S.read_tag_lines(spark, path)
    return bad.groupBy("content").agg(F.count("*").alias("n"))


@register("headerless_scan", "select o_orderkey::int as target, o_custkey as id, o_orderpriority as sentence from orders")
def headerless_scan(spark, sf):
    path = scratch_path(spark, "headerless")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").write.csv(path)
    return S.read_headerless(spark, path, "target int, id bigint, sentence string")


BROKEN_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DoubleType())])


def broken_file(spark, sf):
    path = scratch_path(spark, "broken")
    table(spark, sf, "customer").selectExpr(
        "if(c_nationkey = 3, concat(c_custkey, ',many,', c_acctbal), concat(c_custkey, ',', c_acctbal)) as value"
    ).write.text(path, compression="gzip")
    return path


register("scan_dropping_broken", "select c_custkey as id, c_acctbal as amount from customer where c_nationkey <> 3")(
    lambda spark, sf: S.read_dropping_broken(spark, broken_file(spark, sf), BROKEN_SCHEMA)
)
register(
    "scan_broken_rows",
    "select c_custkey::varchar || ',many,' || c_acctbal as raw from customer where c_nationkey = 3",
)(
    lambda spark, sf: S.read_keeping_broken(spark, broken_file(spark, sf), BROKEN_SCHEMA)[1].select(
        F.col(S.BROKEN).alias("raw")
    )
)


@register(
    "log_to_table",
    "select user_id::varchar as user_id, event_type as kind from events where event_type not in ('error', 'view')",
)
def log_to_table(spark, sf):
    path = scratch_path(spark, "log")
    table(spark, sf, "events").selectExpr("concat(user_id, ' | ', event_type, ' ') as value").write.text(path)
    fields = S.log_to_table(S.read_lines(spark, path), ["error", "view"], " | ")
    return fields.select(F.get("fields", F.lit(0)).alias("user_id"), F.get("fields", F.lit(1)).alias("kind"))


register("table_to_log", "select 'CSV Row: ' || s_suppkey || ', ' || s_name as value from supplier")(
    lambda spark, sf: S.table_to_log(table(spark, sf, "supplier").select("s_suppkey", "s_name"))
)


register(
    "page_text",
    r"""select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'),
        '^\s+|\s+$', '', 'g') as text from pages""",
)(lambda spark, sf: table(spark, sf, "pages").select("page_id", P.plain_markup("html").alias("text")))


@register(
    "markup_files_scan",
    r"""select text as sentence, count(*) as n from (select regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '',
        'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as text from pages) where text <> '' group by 1""",
)
def markup_files_scan(spark, sf):
    """Every page as a markup file of its own, read back from folders of any depth."""
    path = scratch_path(spark, "markup")
    S.write_markup_files(table(spark, sf, "pages"), "page_id", "html", path)
    return S.read_markup_files(spark, path, ".txt").groupBy("sentence").agg(F.count("*").alias("n"))


register(
    "flatten_hits",
    """select event_id, event_type, (props->>'$.k')::int as k, 'forecast' as term, 'events' as site from events""",
)(
    lambda spark, sf: S.flatten_hits(
        table(spark, sf, "events").select(
            F.struct("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k")).alias("_source")
        ),
        {"term": "forecast", "limit": "100"},
        "events",
    ).select("event_id", "event_type", "k", F.col("query_params")["term"].alias("term"), "site")
)


@register("folder_scan", "select lang, count(*) as n, count(distinct source) as sources from documents group by 1")
def folder_scan(spark, sf):
    folder = scratch_path(spark, "folder")
    table(spark, sf, "documents").select("doc_id", "lang", "source").write.json(folder)
    rows = S.read_folder(spark, folder, "doc_id bigint, lang string, source string")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@register(
    "batch_range_scan",
    """select s_suppkey, s_name, s_nationkey as batch_id from supplier where s_nationkey between 3 and 12""",
)
def batch_range_scan(spark, sf):
    root = scratch_path(spark, "batches")
    named = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "s_name", "concat('batch_', s_nationkey, '-prediction') as batch"
    )
    named.write.partitionBy("batch").csv(root, header=True)
    return S.read_batches(
        spark, root, "prediction", "s_suppkey bigint, s_name string", 3, 12, layout="batch=batch_*-{kind}/*.csv"
    )


register(
    "run_record",
    """select count(*) as n_rows, count(*) filter (where quality = 1) as n_positive,
       count(*) filter (where quality = 0) as n_negative, count(*) filter (where quality is null) as n_missing,
       'quality' as rule from labels""",
)(lambda spark, sf: S.run_record(table(spark, sf, "labels"), "quality", "quality").drop("made_at"))
