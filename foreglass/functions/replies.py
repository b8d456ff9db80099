"""Parsing of replies, account strings, dates, ranges and markup into columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from foreglass.functions.text import _col, squeeze_blanks, trimmed

JUDGEMENT = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("reasoning", T.StringType())])
ACCOUNT = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("handle", T.StringType()),
        T.StructField("followers", T.LongType()),
        T.StructField("following", T.LongType()),
    ]
)
PROPERTY_NAMES = ["no_property", "source", "target", "date", "outcome"]

# Sentence templates 1 to 5 and the property behind each bracket.
# Free text between brackets is the reporting verb ("said").
TEMPLATES = {
    1: (
        r"On \[(.*?)\], \[(.*?)\] (.*?) that the \[(.*?)\] at \[(.*?)\] \[(.*?)\] \[(.*?)\] by \[(.*?)\] in \[(.*?)\]\.",
        ["stated_on", "source", "said", "attribute", "target", "aux", "change", "amount", "due"],
    ),
    2: (
        r"In \[(.*?)\], \[(.*?)\] from \[(.*?)\], (.*?) that the \[(.*?)\] \[(.*?)\] \[(.*?)\] from \[(.*?)\] to \[(.*?)\] in \[(.*?)\]\.",
        ["stated_on", "source", "affiliation", "said", "attribute", "aux", "change", "amount_from", "amount", "due"],
    ),
    3: (
        r"\[(.*?)\] (.*?) on \[(.*?)\] that the \[(.*?)\] in \[(.*?)\] \[(.*?)\] \[(.*?)\] by \[(.*?)\] in \[(.*?)\]\.",
        ["source", "said", "stated_on", "attribute", "target", "aux", "change", "amount", "due"],
    ),
    4: (
        r"According to a \[(.*?)\] from \[(.*?)\], on \[(.*?)\], the \[(.*?)\] \[(.*?)\] \[(.*?)\] beyond \[(.*?)\] in the timeframe of \[(.*?)\]\.",
        ["source", "affiliation", "stated_on", "attribute", "aux", "change", "amount", "due"],
    ),
    5: (
        r"In \[(.*?)\], the \[(.*?)\] in \[(.*?)\] \[(.*?)\] \[(.*?)\] by \[(.*?)\], as (.*?) by \[(.*?)\] on \[(.*?)\]\.",
        ["due", "attribute", "target", "aux", "change", "amount", "said", "source", "stated_on"],
    ),
}
TEMPLATE_FIELDS = [
    "stated_on",
    "source",
    "affiliation",
    "said",
    "attribute",
    "target",
    "aux",
    "change",
    "amount_from",
    "amount",
    "due",
]


def template_number(text) -> Column:
    """Number of a leading ``T0:`` .. ``T6:`` word, else NULL."""
    found = F.regexp_extract(_col(text), r"^\s*T([0-6]):(?:\s|$)", 1)
    return F.when(found != "", found.cast("int"))


def without_template_tag(text) -> Column:
    return F.substring(_col(text), 5, 2**31 - 1)


def template_properties(text, number) -> Column:
    """Struct of the bracketed properties; NULL where text and template disagree."""
    text, number = _col(text), _col(number)
    fields = []
    for field in TEMPLATE_FIELDS:
        value = F.lit(None).cast("string")
        for k, (pattern, names) in TEMPLATES.items():
            if field in names:
                part = F.regexp_extract(text, "^" + pattern, names.index(field) + 1)
                value = F.when(number == k, part).otherwise(value)
        fields.append(value.alias(field))
    fits = F.lit(False)
    for k, (pattern, _) in TEMPLATES.items():
        fits = fits | ((number == k) & text.rlike("^" + pattern))
    return F.when(fits, F.struct(*fields))


def _strict_json(text: Column, schema: T.StructType) -> Column:
    """Parsed struct, or NULL where the text is not valid JSON for the schema.

    The corrupt-record column separates broken text from missing fields, so a
    half-read record never passes as a result.
    """
    wide = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(text, wide, {"columnNameOfCorruptRecord": "_broken"})
    whole = F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields])
    return F.when(parsed.isNotNull() & parsed["_broken"].isNull(), whole)


def judgement(reply) -> Column:
    """``{label, reasoning}`` from the outermost braces of a reply; bad JSON gives NULL."""
    return _strict_json(F.regexp_extract(_col(reply), r"(?s)\{.*\}", 0), JUDGEMENT)


def property_lists(reply) -> Column:
    """Five comma-joined property strings from ``{0: [..], 1: [..], ..}``.

    Integer or string keys, quoted or bare items; anything else gives ``""``.
    """
    body = F.regexp_extract(_col(reply), r"(?s)\{.*\}", 0)
    keyed = F.regexp_replace(body, r"""([{,]\s*)['"]?(\d+)['"]?\s*:""", '$1"$2":')
    quoted = F.regexp_replace(keyed, r"""(?<=[\[,])\s*'([^'\]]*)'\s*(?=[,\]])""", '"$1"')
    bare = F.regexp_replace(quoted, r"""(?<=[\[,])\s*([^\s"'\[\],{}:][^"'\[\],{}:]*?)\s*(?=[,\]])""", '"$1"')
    parsed = F.from_json(bare, "map<string,array<string>>")
    return F.struct(
        *[
            F.coalesce(F.array_join(F.try_element_at(parsed, F.lit(str(k))), ", "), F.lit("")).alias(name)
            for k, name in enumerate(PROPERTY_NAMES)
        ]
    )


def account_fields(account) -> Column:
    """Struct from a single-quoted account string; NULL when it is not valid JSON."""
    return _strict_json(F.replace(_col(account), F.lit("'"), F.lit('"')), ACCOUNT)


def parse_timestamp(text, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(_col(text), F.lit(pattern)) if pattern else F.try_to_timestamp(_col(text))


def number_array(text) -> Column:
    """``[0.1 0.2]`` or ``0.1, 0.2`` as an array of doubles."""
    body = trimmed(F.regexp_replace(trimmed(text), r"^\[|\]$", ""))
    return F.transform(F.split(body, r"[,\s]+"), lambda x: x.try_cast("double"))


def int_or(text, default: int = -1) -> Column:
    return F.coalesce(_col(text).try_cast("int"), F.lit(default))


def span_and_years(text) -> Column:
    """``11 years 02026-02036`` -> (duration, years); no match keeps the text as years."""
    flat = trimmed(squeeze_blanks(F.regexp_replace(_col(text), r"\s+", " ")))
    pattern = r"^([?\d]+(?: years)?) (\d{5}-\d{5}|\d{5}-\?{3})"
    return F.when(
        flat.rlike(pattern),
        F.struct(F.regexp_extract(flat, pattern, 1).alias("duration"), F.regexp_extract(flat, pattern, 2).alias("years")),
    ).otherwise(F.struct(F.lit(None).cast("string").alias("duration"), flat.alias("years")))


def money_stake(text) -> Column:
    """First ``$400`` or ``$400 $200``; NULL if none."""
    found = F.regexp_extract(_col(text), r"\$[\d,]+(?:\s+\$[\d,]+)?", 0)
    return F.when(found != "", found)


def absolute_url(href, page_url) -> Column:
    """Resolve a link against its page: full, protocol-relative, rooted, or relative."""
    href, page_url = _col(href), _col(page_url)
    root = F.regexp_extract(page_url, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(page_url, r"[?#].*$", ""), r"(^https?://[^/]+$)|([^/]*$)", "$1")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page_url, r"^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def hrefs(html) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(r'href="([^"]+)"'))


def elements(html, tag: str, css_class: str | None = None) -> Column:
    """Plain text of each element of a tag (optionally of one class), in page order."""
    attributes = rf'[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*' if css_class else r"(?:\s[^>]*)?"
    inner = F.regexp_extract_all(_col(html), F.lit(rf"(?s)<{tag}{attributes}>(.*?)</{tag}>"))
    return F.transform(inner, lambda part: plain_markup(part))


def plain_markup(html) -> Column:
    """Tags removed, whitespace collapsed to single blanks, ends trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(_col(html), r"<[^>]+>", ""), r"\s+", " "))
