"""Benchmark passages in documents, by one Aho-Corasick automaton over normalised items."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEEP = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
#: One table for both steps: A-Z become a-z, bytes outside of words become blanks.
NORMAL = bytes(LOWER[c] if LOWER[c] in _KEEP else 32 for c in range(256))
FIRST_SIGN = 0xE000  # words are written as single characters from here on, above the surrogates
BLOCK_BYTES = 1 << 20

RUNS = "array<struct<first:long,last:long>>"
SPANS = "array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of digits, a-z and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows(words: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    """Runs of ``width`` words; a shorter text with words is one window."""
    if words:
        for i in range(max(1, len(words) - width + 1)):
            yield tuple(words[i : i + width])


class Automaton:
    """Aho-Corasick over windows, with every known word written as one character."""

    def __init__(self, items: list[tuple[object, str | None]], width: int) -> None:
        import ahocorasick

        signs: dict[bytes, str] = {}
        found: dict[str, set[int]] = {}
        self.ids: list[object] = []
        for item, text in items:
            self.ids.append(item)
            for window in windows(words_of(text), width):
                key = "".join(signs.setdefault(w, chr(FIRST_SIGN + len(signs))) for w in window)
                found.setdefault(key, set()).add(len(self.ids) - 1)
        self.sign = signs.get
        self.tree = ahocorasick.Automaton()
        for key, owners in found.items():
            self.tree.add_word(key, (len(key), tuple(owners)))
        self.any = bool(found)
        if self.any:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (first, last) of all occurrences, and the items they belong to."""
        if not self.any or not words:
            return [], set()
        sign = self.sign
        line = "".join([sign(w, "\0") for w in words])
        ranges, owners = [], set()
        for end, (length, who) in self.tree.iter(line):
            ranges.append((end - length + 1, end))
            owners.update(who)
        return ranges, owners


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint word ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def character_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of word ranges."""
    if not runs:
        return []
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    places = [m.span() for m in WORD.finditer(lower)]
    return [{"start": places[a][0], "end": places[b][1]} for a, b in runs]


def _scanner(items: list[tuple[object, str | None]], width: int, schema: pa.Schema):
    """Scan whole texts for a block of items, adding to what earlier blocks found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(items, width)
        for batch in batches:
            old_runs, old_items = (batch.column(c).to_pylist() for c in ("runs", "items"))
            counts, runs, hits, spans = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                words = words_of(text)
                ranges, owners = automaton.scan(words)
                cover = merged(ranges + [(r["first"], r["last"]) for r in old_runs[i]])
                counts.append(len(words))
                runs.append([{"first": a, "last": b} for a, b in cover])
                hits.append(old_items[i] + [automaton.ids[k] for k in sorted(owners)])
                spans.append(character_spans(text, cover) if cover else [])
            made = {"n_words": counts, "runs": runs, "items": hits, "spans": spans}
            columns = [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan


def find_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Occurrences of benchmark items (questions, answers) in whole documents.

    Words are lower-cased runs of digits, letters and all beyond ASCII. Any ``width``
    consecutive words of an item, or all of a shorter item, are a window. Item words are
    written as single characters, so an automaton node stands for a word and a match
    position is a word number; ranges are then mapped to characters of the original.

    Items go to the tasks in blocks of at most ``block_bytes`` of text (plus one item),
    one automaton each; a benchmark of one block scans every text once, a larger one
    once per block within the same task. No text is shuffled.

    Returns ``id, n_words, n_hit, runs, spans, items``: ``runs`` are hit word ranges,
    ``spans`` their start and end characters, ``items`` the distinct ids found, and the
    columns named in ``carry`` as a struct ``carried``. Null
    texts have no words. Items of null id mark words but are not listed; items without
    words are nowhere. Repeated documents give a row each; an item given twice is one.
    """
    given = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    nothing = lambda kind: F.array().cast(kind)
    state = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.struct(*carry).alias("carried") if carry else F.lit(0).alias("carried"),
        F.lit(0).cast("long").alias("n_words"),
        nothing(RUNS).alias("runs"),
        nothing(SPANS).alias("spans"),
        nothing(f"array<{given.schema['item'].dataType.simpleString()}>").alias("items"),
    )
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for number in range(blocks):
        held = [(r["item"], r["text"]) for r in given.filter(part == number).collect()]
        state = state.mapInArrow(_scanner(held, width, to_arrow_schema(shape)), shape)
    listed = F.array_distinct(F.filter("items", lambda x: x.isNotNull()))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    out = state.select("id", "n_words", hit.alias("n_hit"), "runs", "spans", listed.alias("items"), "carried")
    return out if carry else out.drop("carried")
