"""Text functions: every one maps a string Column to a Column, all JVM-side.

Patterns spell out their character classes, so that ``.`` and word boundaries
mean the same on accented text everywhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Contraction -> expansion, matched case-sensitively on whole words.
CONTRACTIONS = {
    "ain't": "am not",
    "aren't": "are not",
    "can't": "cannot",
    "couldn't": "could not",
    "didn't": "did not",
    "doesn't": "does not",
    "don't": "do not",
    "hadn't": "had not",
    "hasn't": "has not",
    "haven't": "have not",
    "he's": "he is",
    "isn't": "is not",
    "it's": "it is",
    "let's": "let us",
    "mustn't": "must not",
    "shan't": "shall not",
    "she's": "she is",
    "shouldn't": "should not",
    "that's": "that is",
    "there's": "there is",
    "they're": "they are",
    "wasn't": "was not",
    "we're": "we are",
    "weren't": "were not",
    "won't": "will not",
    "wouldn't": "would not",
    "you're": "you are",
    "you'll": "you will",
    "you'd": "you would",
    "we'll": "we will",
    "we've": "we have",
    "we'd": "we would",
    "I'm": "I am",
    "i've": "I have",
    "I've": "I have",
    "I'd": "I would",
    "it'll": "it will",
    "they'll": "they will",
    "they've": "they have",
    "they'd": "they would",
    "he'll": "he will",
    "he'd": "he would",
    "she'll": "she will",
    "you've": "you have",
    "I'll": "I will",
    "it'd": "it would",
    "i'm": "I am",
    "that'll": "that will",
    "that'd": "that would",
    "who's": "who is",
    "who'll": "who will",
    "who'd": "who would",
    "what's": "what is",
    "what'll": "what will",
    "what'd": "what would",
    "when's": "when is",
    "when'll": "when will",
    "when'd": "when would",
    "where's": "where is",
    "where'll": "where will",
    "where'd": "where would",
    "why's": "why is",
    "why'll": "why will",
    "why'd": "why would",
    "how's": "how is",
    "how'll": "how will",
    "how'd": "how would",
}

# Words that mark a future statement, and words that name one.
FUTURE_VERBS = ["will", "shall", "would", "going", "might", "should", "could", "may", "must", "can"]
FORECAST_NOUNS = [
    "forecast",
    "projection",
    "estimate",
    "outlook",
    "expectation",
    "anticipation",
    "prophecy",
    "prognosis",
    "guess",
    "speculation",
    "forecasting",
    "foretelling",
    "forecasted outcome",
    "forecast estimate",
]

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def _col(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def lower_case(text) -> Column:
    return F.lower(_col(text))


def strip_markup_and_urls(text) -> Column:
    """Tags (on one line) become a blank, then ``http...`` words vanish."""
    without_tags = F.regexp_replace(_col(text), r"<[^\n]*?>", " ")
    return F.regexp_replace(without_tags, r"(?U)http\S+", "")


def trimmed(text) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def whitespace_tokens(text, lower: bool = True) -> Column:
    """Words between whitespace; an empty or blank text has none."""
    source = F.lower(_col(text)) if lower else _col(text)
    return F.regexp_extract_all(source, F.lit(r"(\S+)"))


def expand_contractions(text, table: Mapping[str, str] = CONTRACTIONS) -> Column:
    """Replace whole contracted words; whitespace runs become one blank."""
    pairs = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])

    def expand(word: Column) -> Column:
        found = F.coalesce(F.try_element_at(pairs, word), word)
        return F.when(F.contains(word, F.lit("'")), found).otherwise(word)

    return F.array_join(F.transform(whitespace_tokens(text, lower=False), expand), " ")


def letters_only(text) -> Column:
    return F.regexp_replace(_col(text), r"[^a-zA-Z\s]", " ")


def drop_symbols(text) -> Column:
    """Symbols other than ``$`` and ``%`` become a blank."""
    return F.regexp_replace(_col(text), r"[^a-zA-Z0-9$%\s]", " ")


def squeeze_blanks(text) -> Column:
    """Runs of blanks become one; tabs and line breaks stay."""
    return F.regexp_replace(_col(text), " +", " ")


def ascii_fold(text) -> Column:
    """Accents removed, then only ASCII letters and `` .,;'`` kept."""
    accented, plain = [], []
    for point in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base.isascii() and base.isalpha():
            accented.append(chr(point))
            plain.append(base)
    folded = F.translate(_col(text), "".join(accented), "".join(plain))
    return F.regexp_replace(folded, r"[^a-zA-Z .,;']", "")


def word_tokens(text) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("(" + WORD + "{2,})"))


def surface_tokens(text) -> Column:
    """Words and single punctuation marks, with the white space before them."""
    return F.regexp_extract_all(_col(text), F.lit(rf"(\s*(?:{WORD}+|[^\p{{L}}\p{{N}}_\s]))"))


def token_shape(token) -> Column:
    """``Xxxx`` / ``dd`` style shape; runs are cut after four characters."""
    shape = F.regexp_replace(_col(token), r"\p{Lu}", "X")
    shape = F.regexp_replace(shape, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "x")
    shape = F.regexp_replace(shape, r"\p{Nd}", "d")
    for run in "Xxd":
        shape = F.regexp_replace(shape, run + "{5,}", run * 4)
    return shape


def sentence_shape(text) -> Column:
    """Shapes of the whitespace-separated words, joined by blanks.

    The shape rules work on characters, so they run over the text once.
    """
    return F.array_join(whitespace_tokens(token_shape(text), lower=False), " ")


def mentions_any(text, words: Iterable[str]) -> Column:
    """True if any of the words occurs as a whole word, in any case."""
    options = "|".join(sorted(words, key=len, reverse=True))
    return F.lower(_col(text)).rlike(rf"(?:^|{NOT_WORD})(?:{options})(?:{NOT_WORD}|$)")


def contains_text(text, part: str) -> Column:
    """Case-insensitive substring test; a missing text gives False."""
    return F.coalesce(F.contains(F.lower(_col(text)), F.lit(part.lower())), F.lit(False))


def keyword_match(text, all_of: Iterable[Iterable[str]]) -> Column:
    """AND over groups, OR inside a group, as a keyword query on posts."""
    lowered = F.lower(_col(text))
    result = F.lit(True)
    for group in all_of:
        any_word = F.lit(False)
        for word in group:
            any_word = any_word | F.contains(lowered, F.lit(word.lower()))
        result = result & any_word
    return F.coalesce(result, F.lit(False))


def reply_lines(text) -> Column:
    """Non-empty lines of a reply, trimmed."""
    lines = F.transform(F.split(_col(text), "\n"), lambda line: trimmed(line))
    return F.filter(lines, lambda line: line != "")


def word_chunks(words, size: int = 512, overlap: int = 32) -> Column:
    """Overlapping runs of a word array column, as texts; every word is covered."""
    words = _col(words)
    step = size - overlap
    last = F.greatest(F.ceil((F.size(words) - overlap) / F.lit(step)), F.lit(1)) - 1
    starts = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: i * step + 1)
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s, size), " "))


def sentence_pieces(text) -> Column:
    """Pieces between sentence marks or line breaks, trimmed, empty ones dropped."""
    pieces = F.transform(F.split(_col(text), r"[.!?\n]+"), lambda p: trimmed(p))
    return F.filter(pieces, lambda p: p != "")


def with_term_counts(df: DataFrame, tokens: Column, name: str = "terms") -> DataFrame:
    """Add ``array<struct<term, n>>``, one entry per distinct token, sorted by term.

    Sorting first makes equal tokens neighbours, so one pass over the run ends
    gives the counts: n log n per text and nothing is shuffled. The steps are
    separate columns, so that Spark evaluates each of them once per row. Spread
    the result with ``explode_terms``.
    """
    ordered, ends = F.col("_ordered"), F.col("_ends")
    length = F.size(ordered)
    run_ends = F.filter(
        F.sequence(F.lit(1), F.greatest(length, F.lit(1))),
        lambda i: (i <= length) & ~F.get(ordered, i - 1).eqNullSafe(F.get(ordered, i)),
    )

    def entry(end: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        return F.struct(F.get(ordered, end - 1).alias("term"), (end - start).cast("bigint").alias("n"))

    return (
        df.withColumn("_ordered", F.sort_array(tokens))
        .withColumn("_ends", run_ends)
        .withColumn(name, F.transform(ends, entry))
        .drop("_ordered", "_ends")
    )


def explode_terms(df: DataFrame, keys: Iterable[str], name: str = "terms") -> DataFrame:
    """``(keys, term, n)`` rows of a term count column.

    The outer form keeps Spark from copying the counting expressions into an
    extra "is not empty" filter below the projection.
    """
    spread = df.select(*keys, F.explode_outer(name).alias("_t")).filter("_t is not null")
    return spread.select(*keys, "_t.term", "_t.n")
