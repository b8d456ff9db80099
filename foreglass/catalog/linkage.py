"""Record linkage on ``part`` and ``documents``, and the statement graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table, text_table
from foreglass.functions import text as X
from foreglass.operators import graph as G, linkage as L, similar as S

LINKS = """members as (select p_partkey, 'p_brand' as key_name, p_brand as key from part
      union all select p_partkey, 'p_size', p_size::varchar from part),
    links as (select key_name, key, p_partkey, min(p_partkey) over (partition by key_name, key) as anchor from members
      qualify anchor < p_partkey),
    pairs as (select links.*, a.p_name as name_a, b.p_name as name_b, a.p_type as type_a, b.p_type as type_b from links
      join part a on anchor = a.p_partkey join part b on links.p_partkey = b.p_partkey)"""


NEIGHBOURS = """blocks as (select p_brand, p_partkey, p_name, p_type, row_number() over (partition by p_brand
      order by p_name, p_partkey) as n from part where p_brand is not null),
    pairs as (select a.p_brand, a.p_partkey as anchor, b.p_partkey, a.p_name as name_a, b.p_name as name_b,
      a.p_type as type_a, b.p_type as type_b from blocks a join blocks b on a.p_brand = b.p_brand
      and b.n between a.n + 1 and a.n + 6)"""


def neighbours(spark, sf):
    """Parts of a brand next to each other by name, with both sides' values."""
    parts = table(spark, sf, "part")
    pairs = L.neighbour_pairs(parts, "p_partkey", ["p_brand"], ["p_name"], 6)
    return L.linked_values(pairs, parts, "p_partkey", ["p_name", "p_type"])


def links(spark, sf):
    return L.block_links(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_size"])


register("block_links", f"with {LINKS} select key_name, key, anchor, p_partkey from links")(links)

register(
    "block_pair_counts",
    """select 'p_brand' as key_name, p_brand as key, count(*) as n, count(*) * (count(*) - 1) // 2 as pairs from part group by 2
       union all select 'p_size', p_size::varchar, count(*), count(*) * (count(*) - 1) // 2 from part group by 2""",
)(lambda spark, sf: L.block_pair_counts(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_size"]))


def _soundex_sql(column: str) -> str:
    """Phonetic code by string steps: code letters, drop H and W, fold runs, drop vowels."""
    codes = f"translate(regexp_replace(upper({column}), '[^A-Z]', 'A', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    body = f"('0' || replace(substring({codes}, 2), '7', ''))"
    first = f"replace(left({codes}, 1), '7', '0')"
    runs = f"({first} || substring({body}, 2))"
    for digit in "0123456":
        runs = f"regexp_replace({runs}, '{digit}+', '{digit}', 'g')"
    return f"(left(upper({column}), 1) || rpad(left(replace(substring({runs}, 2), '0', ''), 3), 3, '0'))"


register(
    "phonetic_codes", f"select p_partkey, p_name, {_soundex_sql('p_name')} as code from part"
)(lambda spark, sf: table(spark, sf, "part").select("p_partkey", "p_name", F.soundex("p_name").alias("code")))

register(
    "name_distances",
    f"""with {NEIGHBOURS}, c as (select *, {_soundex_sql('name_a')} as phonetic_a, {_soundex_sql('name_b')} as phonetic_b from pairs)
        select p_brand, anchor, p_partkey, levenshtein(name_a, name_b)::int as name_distance,
               levenshtein(phonetic_a, phonetic_b)::int as phonetic_distance from c""",
)(
    lambda spark, sf: L.name_distances(neighbours(spark, sf), "p_name").select(
        "p_brand", "anchor", "p_partkey", "name_distance", "phonetic_distance"
    )
)

register(
    "linked_similarity",
    f"""with {NEIGHBOURS} select p_brand, anchor, p_partkey, round(jaro_winkler_similarity(name_a, name_b), 6) as name_score,
          round((jaro_winkler_similarity(name_a, name_b) + jaro_winkler_similarity(type_a, type_b)) / 2, 6) as score
        from pairs""",
)(
    lambda spark, sf: neighbours(spark, sf)
    .withColumn("n", L.string_similarity("p_name_a", "p_name_b"))
    .withColumn("t", L.string_similarity("p_type_a", "p_type_b"))
    .select(
        "p_brand",
        "anchor",
        "p_partkey",
        F.round("n", 6).alias("name_score"),
        F.round((F.col("n") + F.col("t")) / 2, 6).alias("score"),
    )
)

register("neighbour_pairs", f"with {NEIGHBOURS} select p_brand, anchor, p_partkey from pairs")(
    lambda spark, sf: L.neighbour_pairs(table(spark, sf, "part"), "p_partkey", ["p_brand"], ["p_name"], 6)
)

PIECES = r"""p as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) as ss, lower(text) as t from documents)"""


@register(
    "connected_groups",
    f"""with recursive {PIECES},
        m as (select doc_id, 'text:' || md5(t) as key from p union select doc_id, 'first:' || md5(ss[1]) from p where len(ss) > 0
              union select doc_id, 'last:' || md5(ss[-1]) from p where len(ss) > 0),
        e as (select distinct a.doc_id as x, b.doc_id as y from m a join m b using (key)),
        r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
        select x as doc_id, min(y) as "group" from r group by 1""",
)
def connected_groups(spark, sf):
    docs = text_table(spark, sf).select("doc_id", "text", X.sentence_pieces("text").alias("p"))
    docs = docs.withColumn("p", F.filter("p", lambda s: F.length(s) > 20))
    digest = lambda name, c: F.concat(F.lit(name + ":"), F.md5(c))
    keyed = docs.select(
        "doc_id",
        digest("text", F.lower("text")).alias("whole"),
        digest("first", F.get("p", F.lit(0))).alias("first"),
        digest("last", F.try_element_at("p", F.lit(-1))).alias("last"),
    )
    members = L.key_members(keyed, "doc_id", ["whole", "first", "last"])
    return L.connected_groups(members, "doc_id", "key")


EDGES = """says as (select p_partkey, p_brand as src, split_part(p_name, ' ', 2) as dst, split_part(p_name, ' ', 1) as relation
      from part union all select p_partkey, split_part(p_name, ' ', 2), p_type, null from part),
    edges as (select src, dst, arg_max(relation, p_partkey) as relation from says group by 1, 2)"""


def edges(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_brand", "p_type", "split_part(p_name, ' ', 2) as outcome", "split_part(p_name, ' ', 1) as verb"
    )
    return G.statement_edges(parts, "p_partkey", "p_brand", "p_type", "outcome", "verb")


register("statement_edges", f"with {EDGES} select * from edges")(edges)

register(
    "node_degrees",
    f"""with {EDGES}, d as (select node, count(*) as degree from (select src as node from edges union all select dst
          from edges) group by 1) select node, degree, degree = (select max(degree) from d) as is_hub from d""",
)(lambda spark, sf: G.node_degrees(edges(spark, sf)))


# ---- similarity joins: every partner within the bound, checked against all pairs --------


def _near_sql(source: str, block: str, text: str, most: int) -> str:
    """All pairs of distinct values within ``most`` edits."""
    key = f"{block}, " if block else ""
    same = f"a.{block} = b.{block} and " if block else ""
    return f"""with v as (select {key}{text} as t, count(*) as n from {source} where {text} is not null
          {f'and {block} is not null' if block else ''} group by all)
        select {f'a.{block}, ' if block else ''}a.t as a, b.t as b, a.n as n_a, b.n as n_b, levenshtein(a.t, b.t)::int as distance
        from v a join v b on {same}a.t < b.t and abs(length(a.t) - length(b.t)) <= {most} where levenshtein(a.t, b.t) <= {most}"""


@register("similar_names", _near_sql("part", "p_brand", "p_name", 2))
def similar_names(spark, sf):
    """Names of a brand within two edits."""
    return S.similar_strings(table(spark, sf, "part"), "p_name", 2, ["p_brand"])


@register("similar_links", _near_sql("pages", "", "url", 2))
def similar_links(spark, sf):
    """Addresses of pages within two edits."""
    return S.similar_strings(table(spark, sf, "pages"), "url", 2, q=3)


OPENINGS = r"""(select regexp_replace(ss[1], '[^\x00-\x7F]', '?', 'g') as opening from (select list_filter(list_transform(
      string_split_regex(text, '[.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ss from documents))"""


@register("similar_openings", _near_sql(OPENINGS, "", "opening", 3))
def similar_openings(spark, sf):
    """First sentences of documents within three edits."""
    docs = text_table(spark, sf).select(F.get(X.sentence_pieces("text"), F.lit(0)).alias("opening"))
    plain = docs.select(F.regexp_replace("opening", r"[^\x00-\x7F]", "?").alias("opening"))
    return S.similar_strings(plain, "opening", 3, q=3)


RECORDS = """v as (select p_brand, p_name, p_type, count(*) as n, min(p_partkey) as first from part
      where p_brand is not null and p_name is not null and p_type is not null group by all),
    p as (select a.p_brand, a.p_name as p_name_a, b.p_name as p_name_b, a.p_type as p_type_a, b.p_type as p_type_b, a.n as n_a,
      b.n as n_b, a.first as x, b.first as y,
      round((jaro_winkler_similarity(a.p_name, b.p_name) + jaro_winkler_similarity(a.p_type, b.p_type)) / 2, 6) as score
      from v a join v b on a.p_brand = b.p_brand and (a.p_name, a.p_type) < (b.p_name, b.p_type))"""


@register(
    "similar_records",
    f"with {RECORDS} select p_brand, p_name_a, p_name_b, p_type_a, p_type_b, n_a, n_b, score from p where score >= 0.85",
)
def similar_records(spark, sf):
    """Parts of a brand with a mean name and type similarity of 0.85 or more, one row a pair of different values."""
    pairs = S.similar_records(table(spark, sf, "part"), ["p_brand"], ["p_name", "p_type"], 0.85)
    return pairs.withColumn("score", F.round("score", 6))


@register(
    "resolved_records",
    f"""with recursive {RECORDS}, e as (select x, y from p where score >= 0.9 union all select y, x from p where score >= 0.9),
        r as (select first as x, first as y from v union select r.x, e.y from r join e on r.y = e.x),
        g as (select x, min(y) as g from r group by 1)
        select p_partkey, coalesce(g.g, p_partkey) as "group" from part left join v using (p_brand, p_name, p_type) left join g on g.x = v.first""",
)
def resolved_records(spark, sf):
    """Parts of a brand that are connected by similar names and types."""
    return S.resolved(table(spark, sf, "part"), "p_partkey", ["p_brand"], ["p_name", "p_type"], 0.9)
