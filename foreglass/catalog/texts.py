"""Text functions over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table, text_table
from foreglass.functions import replies as R, text as X
from foreglass.operators import tokens as K

STOP_WORDS = ["the", "of", "and", "la", "le", "der", "die", "und"]
CUES = ["was", "is", "est", "ist"]


def documents(spark, sf_dir):
    return text_table(spark, sf_dir)


def _mapped(make):
    def query(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", make(F.col("text")).alias("out"))

    return query


def _sql_map(pairs):
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in pairs.items()) + "}"


WS = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQL_WORDS = (
    "(case when " + WS.format("{0}") + " = '' then [] else string_split_regex(" + WS.format("{0}") + ", '\\s+') end)"
)

register("lower_case", "select doc_id, lower(text) as out from documents")(_mapped(X.lower_case))

register(
    "strip_markup_and_urls",
    r"""select page_id, regexp_replace(regexp_replace(html, '<[^\n]*?>', ' ', 'g'), 'http\S+', '', 'g') as out
        from pages""",
)(
    lambda spark, sf_dir: text_table(spark, sf_dir, "pages", "page_id").select(
        "page_id", X.strip_markup_and_urls("html").alias("out")
    )
)

register(
    "expand_contractions",
    f"""select doc_id, array_to_string(list_transform({SQL_WORDS.format("replace(text, ' it ', ' it''s ')")},
          lambda w: coalesce({_sql_map(X.CONTRACTIONS)}[w], w)), ' ') as out from documents""",
)(_mapped(lambda c: X.expand_contractions(F.replace(c, F.lit(" it "), F.lit(" it's ")))))

register("letters_only", r"select doc_id, regexp_replace(text, '[^a-zA-Z\s]', ' ', 'g') as out from documents")(
    _mapped(X.letters_only)
)
register("drop_symbols", r"select doc_id, regexp_replace(text, '[^a-zA-Z0-9$%\s]', ' ', 'g') as out from documents")(
    _mapped(X.drop_symbols)
)
register(
    "squeeze_blanks", "select doc_id, regexp_replace(replace(text, ',', '  '), ' +', ' ', 'g') as out from documents"
)(_mapped(lambda c: X.squeeze_blanks(F.replace(c, F.lit(","), F.lit("  ")))))

register(
    "ascii_fold",
    r"select doc_id, regexp_replace(strip_accents(text), '[^a-zA-Z .,;'']', '', 'g') as out from documents",
)(_mapped(X.ascii_fold))

register(
    "whitespace_tokens",
    f"""select doc_id, len(w) as n_words, array_to_string(w, '|') as words
        from (select doc_id, {SQL_WORDS.format('lower(text)')} as w from documents)""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", X.whitespace_tokens("text").alias("w"))
    .select("doc_id", F.size("w").alias("n_words"), F.array_join("w", "|").alias("words"))
)

register(
    "template_tags",
    r"""select doc_id, regexp_extract(t, '^\s*T([0-6]):(\s|$)', 1)::int as template_number,
               substring(t, 5) as sentence
        from (select doc_id, 'T' || (doc_id % 9) || ': ' || text as t from documents)
        where regexp_matches(t, '^\s*T([0-6]):(\s|$)')""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", F.concat(F.lit("T"), F.col("doc_id") % 9, F.lit(": "), "text").alias("t"))
    .select("doc_id", R.template_number("t").alias("template_number"), R.without_template_tag("t").alias("sentence"))
    .filter("template_number is not null")
)

SHAPE = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\p{{Lu}}', 'X', 'g'),
    '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]', 'x', 'g'), '\p{{Nd}}', 'd', 'g')"""
SHAPE = (
    "regexp_replace(regexp_replace(regexp_replace(" + SHAPE + ", 'X{{5,}}', 'XXXX', 'g'), "
    "'x{{5,}}', 'xxxx', 'g'), 'd{{5,}}', 'dddd', 'g')"
)


@register(
    "token_table",
    rf"""with p as (
          select doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as pos
          from (select doc_id, regexp_extract_all(text, '\s*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])') as ps
                from documents)),
        t as (select *, sum(length(piece)) over (partition by doc_id order by pos) as end_char,
                     regexp_replace(piece, '^\s+', '') as term from p)
        select doc_id, pos::int as pos, term, {SHAPE.format('term')} as shape,
               regexp_matches(term, '^\p{{L}}+$') as is_alpha,
               lower(term) in ({', '.join(repr(w) for w in STOP_WORDS)}) as stop_word,
               (end_char - length(term))::int as start_char, end_char::int as end_char
        from t""",
)
def token_table(spark, sf_dir):
    return K.token_table(documents(spark, sf_dir), "doc_id", "text", STOP_WORDS)


register(
    "sentence_shapes",
    f"select doc_id, array_to_string({SQL_WORDS.format('(' + SHAPE.format('text') + ')')}, ' ') as shape from documents",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .withColumn("t", X.token_shape("text"))
    .select("doc_id", F.array_join(X.whitespace_tokens("t", lower=False), " ").alias("shape"))
)

register(
    "cue_mentions",
    r"""select doc_id,
          regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])(?:est|ist|was|is)(?:[^\p{L}\p{N}_]|$)') as has_cue,
          regexp_matches(lower(text),
            '(?:^|[^\p{L}\p{N}_])(?:should|would|shall|might|could|going|will|must|may|can)(?:[^\p{L}\p{N}_]|$)')
            as has_future_verb
        from documents""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir).select(
        "doc_id",
        X.mentions_any("text", CUES).alias("has_cue"),
        X.mentions_any("text", X.FUTURE_VERBS).alias("has_future_verb"),
    )
)

SENTENCES = r"""select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as sentence_no
   from (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'),
                lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as s from documents)"""


@register(
    "sentence_future_flag",
    rf"""with s as ({SENTENCES}),
        w as (select doc_id, sentence_no, unnest({SQL_WORDS.format('lower(sentence)')}) as word from s)
        select doc_id, sentence_no::int as sentence_no,
               max((word in ('was', 'is', 'est', 'ist'))::int) as is_future
        from w group by all""",
)
def sentence_future_flag(spark, sf_dir):
    rows = K.sentences(documents(spark, sf_dir), "doc_id", "text").withColumn("words", X.whitespace_tokens("sentence"))
    return rows.filter(F.size("words") > 0).select("doc_id", "sentence_no", K.has_cue(F.col("words"), CUES).alias("is_future"))


@register(
    "token_future_flag",
    rf"""with s as ({SENTENCES}),
        w as (select doc_id, sentence_no, unnest({SQL_WORDS.format('lower(sentence)')}) as word from s)
        select doc_id, sentence_no::int as sentence_no,
               max((word in ('was', 'is', 'est', 'ist'))::int) as is_future
        from w group by all""",
)
def token_future_flag(spark, sf_dir):
    """The same from a table of tagged tokens, checked for the number of sentences first."""
    rows = K.sentences(documents(spark, sf_dir), "doc_id", "text")
    words = K.word_rows(rows, ["doc_id", "sentence_no"], "sentence").withColumnRenamed("word", "term")
    flags = K.sentence_has_tags(K.tag_cues(words, CUES), ["doc_id", "sentence_no"])
    filled = rows.filter(F.size(X.whitespace_tokens("sentence")) > 0)
    return K.require_rows(flags, filled.count())


register(
    "synonym_mentions",
    rf"""select doc_id, regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(sorted(X.FORECAST_NOUNS, key=len, reverse=True))})(?:[^\p{{L}}\p{{N}}_]|$)')
          as names_forecast from documents""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir).select(
        "doc_id", X.mentions_any("text", X.FORECAST_NOUNS).alias("names_forecast")
    )
)


@register(
    "lemma_join",
    rf"""with w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos
                    from (select doc_id, {SQL_WORDS.format('lower(text)')} as ws from documents)),
        l as (select distinct word as form, regexp_replace(word, '(tion|ing|ung)$', '') as lemma from w
              where regexp_matches(word, '(tion|ing|ung)$'))
        select doc_id, string_agg(coalesce(lemma, word), ' ' order by pos) as lemmas
        from w left join l on word = form group by doc_id""",
)
def lemma_join(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ending = "(tion|ing|ung)$"
    forms = K.word_rows(docs, [], "text").filter(F.col("word").rlike(ending)).select("word").distinct()
    lemmas = forms.select(F.col("word").alias("form"), F.regexp_replace("word", ending, "").alias("lemma"))
    return K.lemmatize(docs, "doc_id", "text", lemmas).select("doc_id", "lemmas")


@register(
    "word_chunks",
    rf"""with w as (select doc_id, {SQL_WORDS.format('text')} as ws from documents),
        s as (select doc_id, ws, unnest(range(0, greatest(ceil((len(ws) - 32) / 480.0), 1)::bigint)) as chunk_no from w)
        select doc_id, chunk_no::int as chunk_no,
               array_to_string(ws[chunk_no * 480 + 1 : chunk_no * 480 + 512], ' ') as chunk from s""",
)
def word_chunks(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", X.whitespace_tokens("text", lower=False).alias("words"))
    return words.select("doc_id", F.posexplode(X.word_chunks("words")).alias("chunk_no", "chunk"))


@register(
    "first_reply_line",
    r"""select conv_id, turn, len(l) as n_lines, l[1] as first_line
        from (select conv_id, turn, list_filter(list_transform(string_split(text, chr(10)),
              lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from conversations)""",
)
def first_reply_line(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.reply_lines("text").alias("l"))
    return lines.select("conv_id", "turn", F.size("l").alias("n_lines"), F.get("l", F.lit(0)).alias("first_line"))


@register(
    "keyword_filter",
    """select doc_id, source from documents
       where (contains(lower(text), 'the') or contains(lower(text), 'la'))
         and (contains(lower(text), 'tion')) and source in ('src1', 'src2', 'src3') and n_chars between 200 and 5000
       order by doc_id limit 50""",
)
def keyword_filter(spark, sf_dir):
    from foreglass.operators.relational import keyword_posts

    return (
        keyword_posts(
            documents(spark, sf_dir),
            "text",
            [["the", "la"], ["tion"]],
            where=F.col("source").isin("src1", "src2", "src3") & F.col("n_chars").between(200, 5000),
            order=["doc_id"],
            limit=50,
        )
        .select("doc_id", "source")
    )
