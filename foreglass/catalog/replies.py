"""Parsing of replies, accounts, dates and markup built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table
from foreglass.functions import replies as P, text as X
from foreglass.operators import events as N

register(
    "judge_replies",
    """select o_orderkey, case when o_orderkey % 4 < 2 then (o_custkey % 2)::int end as label,
              case when o_orderkey % 4 < 2 then o_orderpriority end as reasoning from orders""",
)(
    lambda spark, sf: table(spark, sf, "orders")
    .selectExpr(
        "o_orderkey",
        """case o_orderkey % 4
             when 0 then concat('{"label": ', o_custkey % 2, ', "reasoning": "', o_orderpriority, '"}')
             when 1 then concat('Sure! Here it is:\\n{"label": ', o_custkey % 2, ',\\n "reasoning": "', o_orderpriority, '"} Bye.')
             when 2 then concat('{"label": ', o_custkey % 2, ', "reasoning": }')
             else 'I cannot judge this.' end as reply""",
    )
    .select("o_orderkey", P.judgement("reply").alias("j"))
    .select("o_orderkey", "j.label", "j.reasoning")
)

register(
    "property_replies",
    """select p_partkey, case when p_partkey % 4 = 3 then '' else 'the, of' end as no_property,
              case when p_partkey % 4 = 3 then '' else p_brand end as source,
              case when p_partkey % 4 = 3 then '' else p_name end as target,
              case when p_partkey % 4 = 3 then '' else (2000 + p_size)::varchar end as date, '' as outcome from part""",
)(
    lambda spark, sf: table(spark, sf, "part")
    .selectExpr(
        "p_partkey",
        """case p_partkey % 4
             when 0 then concat("{0: ['the', 'of'], 1: ['", p_brand, "'], 2: ['", p_name, "'], 3: ['", 2000 + p_size, "'], 4: []}")
             when 1 then concat('{"0": ["the", "of"], "1": ["', p_brand, '"], "2": ["', p_name, '"], "3": ["', 2000 + p_size, '"], "4": []}')
             when 2 then concat('Reply: {0: [the, of], 1: [', p_brand, '], 2: [', p_name, '], 3: [', 2000 + p_size, '], 4: []}')
             else 'no braces' end as reply""",
    )
    .select("p_partkey", P.property_lists("reply").alias("p"))
    .select("p_partkey", "p.*")
)

ACCOUNTS = """concat("{'username': '", c_name, if(c_nationkey = 5, "'s", ''), "', 'display_name': '", c_mktsegment,
    "', 'followers': ", c_custkey, ", 'following': ", c_nationkey, "}") as account"""

register(
    "account_columns",
    """select c_custkey, c_name as username, c_mktsegment as display_name, null::varchar as handle, c_custkey as followers,
              c_nationkey::bigint as following from customer where c_nationkey <> 5""",
)(
    lambda spark, sf: table(spark, sf, "customer")
    .selectExpr("c_custkey", ACCOUNTS)
    .select("c_custkey", P.account_fields("account").alias("a"))
    .filter("a is not null")
    .select("c_custkey", "a.*")
)

register("account_errors", "select c_custkey from customer where c_nationkey = 5")(
    lambda spark, sf: table(spark, sf, "customer")
    .selectExpr("c_custkey", ACCOUNTS)
    .select("c_custkey", P.account_fields("account").alias("a"))
    .filter("a is null")
    .select("c_custkey")
)

register(
    "timestamp_parse",
    """select o_orderkey, case when o_orderkey % 5 <> 4 then strftime(o_orderdate, '%Y/%m/%d') end as day from orders""",
)(
    lambda spark, sf: table(spark, sf, "orders")
    .selectExpr("o_orderkey", "if(o_orderkey % 5 = 4, 'soon', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')) as t")
    .select("o_orderkey", F.date_format(P.parse_timestamp("t"), "yyyy/MM/dd").alias("day"))
)

register(
    "number_arrays",
    """select p_partkey, round(p_size + 0.5 + p_retailprice + 1e-3, 4) as total, 3 as n from part""",
)(
    lambda spark, sf: table(spark, sf, "part")
    .selectExpr(
        "p_partkey",
        """if(p_partkey % 2 = 0, concat('[', p_size, '.5  ', p_retailprice, '\\n 1e-3]'),
              concat(p_size, '.5, ', p_retailprice, ', 1e-3')) as t""",
    )
    .select("p_partkey", P.number_array("t").alias("v"))
    .select(
        "p_partkey",
        F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"),
        F.size("v").alias("n"),
    )
)

register(
    "span_and_years",
    """select p_partkey, case p_partkey % 3 when 0 then p_size || ' years' when 1 then '? years' end as duration,
              case p_partkey % 3 when 0 then '0' || (2000 + p_size) || '-0' || (2010 + p_size)
                when 1 then '0' || (2000 + p_size) || '-???' else 'about ' || p_size end as years,
              case p_partkey % 2 when 0 then '$' || p_size || ' $2,000' end as stake from part""",
)(
    lambda spark, sf: table(spark, sf, "part")
    .selectExpr(
        "p_partkey",
        """case p_partkey % 3 when 0 then concat(p_size, '  years\\n0', 2000 + p_size, '-0', 2010 + p_size)
             when 1 then concat('? years 0', 2000 + p_size, '-???') else concat('about ', p_size) end as t""",
        "if(p_partkey % 2 = 0, concat('for $', p_size, ' $2,000 each'), 'no stake') as m",
    )
    .select("p_partkey", P.span_and_years("t").alias("s"), P.money_stake("m").alias("stake"))
    .select("p_partkey", "s.duration", "s.years", "stake")
)

LINKS = r"""links as (select page_id, url, unnest(regexp_extract_all(replace(html, '">', '.pdf">'), 'href="([^"]+)"', 1))
    as href from pages)"""


def pdf_links(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit('">'), F.lit('.pdf">')))
    links = pages.select("page_id", "url", F.explode(P.hrefs("html")).alias("href"))
    return links.filter(F.col("href").endswith(".pdf") & F.lower("href").rlike("e|la")).select(
        "page_id", "href", P.absolute_url("href", "url").alias("link")
    )


register(
    "document_links",
    rf"""with {LINKS} select page_id, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href as link from links
        where href like '%.pdf' and regexp_matches(lower(href), 'e|la')""",
)(pdf_links)

register(
    "distinct_links",
    rf"""with {LINKS} select distinct regexp_extract(url, '^(https?://[^/?#]+)', 1) || href as link from links
        where href like '%.pdf' and regexp_matches(lower(href), 'e|la')""",
)(lambda spark, sf: pdf_links(spark, sf).select("link").distinct())

register(
    "list_items",
    r"""select page_id, unnest(l) as item, (generate_subscripts(l, 1) - 1)::int as item_no from
        (select page_id, list_transform(regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1),
           lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))
           as l from pages)""",
)(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id", F.posexplode(P.elements("html", "li")).alias("item_no", "item")
    )
)

register(
    "elements_by_class",
    r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html,
          '(?s)<div[^>]*class="[^"]*\bad\b[^"]*"[^>]*>(.*?)</div>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'),
          '^\s+|\s+$', '', 'g') as text from pages where contains(html, 'class="ad"')""",
)(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id", F.explode(P.elements("html", "div", "ad")).alias("text")
    )
)

register(
    "nested_event_search",
    r"""with s as (select doc_id, lang, source, unnest(ss) as sentence, generate_subscripts(ss, 1) as i from
          (select doc_id, lang, source, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'),
             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ss from documents))
        select doc_id, n_time as time, lang as location, source as subject, sentence as object
        from (select *, '0' || (2000 + i) as n_time, case when contains(lower(sentence), 'tion') then 'prediction'
              else 'report' end as kind from s)
        where kind = 'prediction'""",
)(
    lambda spark, sf: N.event_columns(
        N.matching_events(
            table(spark, sf, "documents")
            .withColumn("pieces", X.sentence_pieces("text"))
            .select(
                "doc_id",
                F.array(
                    F.transform(
                        "pieces",
                        lambda s, i: F.struct(
                            F.when(F.contains(F.lower(s), F.lit("tion")), "prediction").otherwise("report").alias("Event"),
                            F.concat(F.lit("0"), i + 2001).alias("Time"),
                            F.col("lang").alias("Location"),
                            F.col("source").alias("Subject"),
                            s.alias("Object"),
                        ),
                    )
                ).alias("groups"),
            ),
            "doc_id",
            "groups",
            "PREDICTION",
        ),
        "doc_id",
        "prediction",
    )
)

SENTENCE_OF = {
    1: "On [{due}], [{name}] says that the [{attr}] at [{brand}] [will] [rise] by [{size}%] in [2031].",
    2: "In [{due}], [{name}] from [{brand}], says that the [{attr}] [will] [fall] from [9] to [{size}] in [2032].",
    3: "[{name}] says on [{due}] that the [{attr}] in [{brand}] [may] [rise] by [{size}] in [2033].",
    4: "According to a [{name}] from [{brand}], on [{due}], the [{attr}] [may] [rise] beyond [{size}] in the timeframe of [2034].",
    5: "In [2035], the [{attr}] in [{brand}] [should] [stay] by [{size}], as said by [{name}] on [{due}].",
}

def _concat(template: str) -> str:
    text = template
    for field, column in (("due", "2020 + p_size"), ("name", "p_name"), ("attr", "p_type"), ("brand", "p_brand")):
        text = text.replace("{" + field + "}", f"', {column}, '")
    return "concat('" + text.replace("{size}", "', p_size, '") + "')"


register(
    "template_properties",
    """select p_partkey, k as template, (2020 + p_size)::varchar as stated_on,
         p_name as source, case when k in (2, 4) then p_brand end as affiliation,
         case k when 5 then 'said' when 4 then null else 'says' end as said, p_type as attribute,
         case when k in (1, 3, 5) then p_brand end as target,
         case k when 1 then 'will' when 2 then 'will' when 5 then 'should' else 'may' end as aux,
         case k when 2 then 'fall' when 5 then 'stay' else 'rise' end as change,
         case k when 2 then '9' end as amount_from,
         case k when 1 then p_size || '%' else p_size::varchar end as amount, (2030 + k)::varchar as due
       from (select *, (p_partkey % 5 + 1)::int as k from part) where p_partkey % 7 <> 0""",
)(
    lambda spark, sf: table(spark, sf, "part")
    .withColumn("template", (F.col("p_partkey") % 5 + 1).cast("int"))
    .withColumn(
        "sentence",
        F.expr(
            "case when p_partkey % 7 = 0 then 'no template here' else case template "
            + " ".join(f"when {k} then {_concat(t)}" for k, t in SENTENCE_OF.items())
            + " end end"
        ),
    )
    .select("p_partkey", "template", P.template_properties("sentence", "template").alias("p"))
    .filter("p is not null")
    .select("p_partkey", "template", "p.*")
)
