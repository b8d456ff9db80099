"""Toxic texts: a lexicon trie crossed with Levenshtein automata, and scores of context windows."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foreglass.llm.sampling import bounded_sample
from foreglass.llm.words import SLICE_BYTES, Words, row_slices, text_buffer, word_bytes
from foreglass.scale import written_once

NOT_A_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that announce that someone else's words follow, and words that address the reader.
REPORTING = {"said", "says", "called", "calls", "wrote", "writes", "quote", "quoted", "word", "term", "phrase", "heißt", "sagte", "dit", "dijo"}
ADDRESS = {"you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "eres", "tú", "usted"}
QUOTES = ('"', "“", "”", "«", "»", "„", "‘", "`")
#: What closes a quotation that a mark has opened.
CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "`": "`'"}
#: A short passage between quotation marks.
QUOTED = f"[{''.join(QUOTES)}][^{''.join(QUOTES)}]{{1,200}}[{''.join(QUOTES)}’]"
WINDOW = 6
FUZZY_FROM = 5  # shorter terms must be spelled right, longer ones may have one edit
TWICE_FROM = 8  # and from here on two
SCARE = 3  # words of a quotation that may be scare quotes
MATCHES = "array<struct<entry:int,edits:int,quoted:boolean,address:boolean,near:int>>"


@dataclass(frozen=True)
class Entry:
    """A term of the lexicon; a stem matches whatever follows it in the word."""

    term: str
    stem: bool


def edits_allowed(term: str, fuzzy_from: int = FUZZY_FROM) -> int:
    return 0 if len(term) < fuzzy_from else 1 if len(term) < TWICE_FROM else 2


class Automaton:
    """All Levenshtein automata of a lexicon, run along its trie and made deterministic where words go.

    A state is the set of (trie node, edits so far, character still due after a swap) that
    a word read so far can be in. An edit is a character added, left out or changed, or
    two neighbours swapped. Words of a whole batch step through the table together, one
    character at a time, and leave as soon as no term can be reached; steps that no word
    has taken yet are worked out when the first one does.
    """

    def __init__(self, entries: list[Entry], fuzzy_from: int = FUZZY_FROM) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.ends: dict[int, tuple[int, bool]] = {}
        self.reach = [0]  # edits that some term below a node allows
        self.allowed = [edits_allowed(e.term, fuzzy_from) for e in entries]
        for number, entry in enumerate(entries):
            node, allowed = 0, self.allowed[number]
            self.reach[0] = max(self.reach[0], allowed)
            for code in map(ord, entry.term):
                if code not in self.children[node]:
                    self.children[node][code] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][code]
                self.reach[node] = max(self.reach[node], allowed)
            if node not in self.ends or entry.stem:
                self.ends[node] = (number, entry.stem)
        self.used = np.array(sorted({c for children in self.children for c in children}), np.int64)  # class 0 is every other character
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.table = np.zeros((0, len(self.used) + 1), np.int32)
        self.result: list[tuple[int, int]] = []
        self._number(frozenset())
        self._number(self._closed({(0, 0, 0)}))

    def _number(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            found = [(edits, self.ends[node][0]) for node, edits, due in state if not due and node in self.ends and edits <= self.allowed[self.ends[node][0]]]
            edits, entry = min(found, default=(0, -1))
            self.result.append((entry, edits))
            if len(self.states) > len(self.table):
                more = np.full((max(256, len(self.table)), len(self.used) + 1), -1, np.int32)
                self.table = np.concatenate([self.table, more])
        return self.number[state]

    def _closed(self, pairs: set[tuple[int, int, int]]) -> frozenset:
        """Skipping a term's character is an edit too; fewer edits at a node make more useless."""
        best: dict[tuple[int, int], int] = {}
        todo = list(pairs)
        while todo:
            node, edits, due = todo.pop()
            if edits > self.reach[node] or best.get((node, due), 9) <= edits:
                continue
            best[node, due] = edits
            if not due and not (node in self.ends and self.ends[node][1]):
                todo.extend((child, edits + 1, 0) for child in self.children[node].values())
        return frozenset((node, edits, due) for (node, due), edits in best.items())

    def _step(self, state: frozenset, code: int) -> frozenset:
        after = set()
        for node, edits, due in state:
            if due:
                if due == code:
                    after.add((node, edits, 0))
                continue
            if node in self.ends and self.ends[node][1]:
                after.add((node, edits, 0))  # a stem is complete; the rest of the word is free
            after.add((node, edits + 1, 0))
            for first, child in self.children[node].items():
                after.add((child, edits + (first != code), 0))
                if code in self.children[child] and first != code:
                    after.add((self.children[child][code], edits + 1, first))
        return self._closed(after)

    def _steps(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        after = self.table[state, kind]
        if (after < 0).any():
            for s, k in np.unique(np.stack([state, kind], axis=1)[after < 0], axis=0).tolist():
                reached = self._number(self._step(self.states[s], int(self.used[k - 1]) if k else -1))
                self.table[s, k] = reached
            after = self.table[state, kind]
        return after

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, entries, edits) of the words that match; codes are code points."""
        none = np.zeros(0, np.int64)
        if not len(self.used):
            return none, none, none
        place = np.minimum(np.searchsorted(self.used, codes), len(self.used) - 1)
        kinds = np.where(self.used[place] == codes, place + 1, 0)
        length = ends - starts
        live = np.arange(len(starts))
        state = np.ones(len(starts), np.int32)
        hit, result = [], []
        at = 0
        while len(live):
            over = length[live] == at
            if over.any():
                hit.append(live[over])
                result.append(state[over])
                live, state = live[~over], state[~over]
                if not len(live):
                    break
            state = self._steps(state, kinds[starts[live] + at])
            alive = state > 0
            if not alive.all():
                live, state = live[alive], state[alive]
            at += 1
        if not hit:
            return none, none, none
        words, final = np.concatenate(hit), np.concatenate(result)
        entry, edits = np.array(self.result, np.int64).T
        good = entry[final] >= 0
        order = np.argsort(words[good])
        return words[good][order], entry[final[good]][order], edits[final[good]][order]


def quotations(text: str) -> list[tuple[int, int]]:
    """Outermost quotations as (first mark, last mark), by opening and closing marks.

    Marks of other kinds nest. A quotation ends with its paragraph: a mark that is not
    closed there quotes nothing, and a closing mark that nothing opened is ignored. A mark
    inside a word, or right behind a digit, is an apostrophe or a unit.
    """
    found, opened, end = [], [], len(text)
    for at, mark in _marks(text):
        if mark == "\n":
            opened = []
            continue
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        closes = [i for i, (_, kind) in enumerate(opened) if mark in CLOSERS[kind]]
        if closes and not (mark in "’'" and after.isalnum()):
            first = opened[closes[-1]][0]
            opened = opened[: closes[-1]]
            while found and found[-1][0] > first:
                found.pop()
            found.append((first, at))
        elif mark in CLOSERS and not (before.isdigit() and mark == '"') and not (before.isalnum() and after.isalnum()) and at + 1 < end:
            opened.append((at, mark))
    return found


def _marks(text: str) -> Iterator[tuple[int, str]]:
    return ((m.start(), m[0]) for m in MARK.finditer(text))


MARK = re.compile("[\n’'" + "".join(QUOTES) + "]")
MARK_CODES = np.array([ord(c) for c in "’" + "".join(QUOTES)])


class Scanner:
    """Matches of a lexicon with what their windows say, for batches of texts."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.words = Words(word_bytes(NOT_A_WORD))

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        text = data.tobytes().decode("utf-8", "replace")
        begun = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters before each byte
        offsets = begun[offsets]
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds = np.where(np.isin(codes, MARK_CODES), 32, np.minimum(codes, 255)).astype(np.uint8)  # marks are no part of words
        starts, ends, first = self.words.spans(kinds, offsets)
        found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        codes[(codes >= 65) & (codes <= 90)] += 32
        words, entries, edits = self.automaton.run(codes, starts, ends)
        rows = np.searchsorted(first, words, "right") - 1
        word = lambda i: text[starts[i] : ends[i]].lower()
        spans, held = [], -1
        for i, at in enumerate(words):
            row = rows[i]
            if row != held:
                spans, held = quotations(text[offsets[row] : offsets[row + 1]]), row
            lo, hi = max(first[row], at - WINDOW), min(first[row + 1], at + WINDOW + 1)
            place = starts[at] - offsets[row]
            k = bisect.bisect_right(spans, (place, len(text))) - 1
            inside = k >= 0 and spans[k][0] < place < spans[k][1]
            quoted, address = bool(inside), bool(ADDRESS & {word(j) for j in range(lo, hi)})
            if inside:
                a, b = np.searchsorted(starts, [offsets[row] + spans[k][0], offsets[row] + spans[k][1]])
                around = {word(j) for j in range(lo, hi) if not a <= j < b}
                reported = REPORTING & {word(j) for j in range(max(first[row], a - 3), a)}
                # A few words in marks that someone is addressed with are not a quotation.
                quoted = b - a > SCARE or bool(reported) or not ADDRESS & around
            near = np.searchsorted(words, [lo, hi])
            found[row].append(
                {"entry": int(entries[i]), "edits": int(edits[i]), "quoted": quoted, "address": address, "near": int(near[1] - near[0] - 1)}
            )
        return found

    def matches(self, column: pa.Array) -> Iterator[tuple[int, list[list[dict]]]]:
        """(first row, matches per row) for slices of a text column."""
        data, offsets = text_buffer(column)
        for lo, hi in row_slices(offsets):
            part = offsets[lo : hi + 1]
            text = data[part[0] : part[-1]]
            if len(text) <= 2 * SLICE_BYTES:
                yield lo, self._piece(text, part - part[0])
            else:  # one long text: windows end at pieces of some MB
                yield lo, [[m for a, b in self.words.pieces(text) for m in self._piece(text[a:b], np.array([0, b - a]))[0]]]


@dataclass
class Model:
    entries: list[Entry]
    automaton: Automaton
    by_edits: np.ndarray  # weight of each entry spelled right, with one edit, and with two
    weights: np.ndarray

    def features(self, matches: list[dict]) -> list[float]:
        """What the windows of a text add up to: abuse and quotation apart."""
        best = total = quoted = address = 0.0
        seen = set()
        for m in matches:
            weight = self.by_edits[m["edits"], m["entry"]]
            if weight <= 0:
                continue
            if m["quoted"]:
                quoted = max(quoted, weight)
                continue
            best = max(best, weight)
            total += weight * (1 + 0.25 * min(m["near"], 4))
            address = max(address, weight if m["address"] else 0)
            seen.add(m["entry"])
        return [best, math.log1p(total), quoted, address, math.log1p(len(seen))]

    def score(self, matches: list[dict]) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(matches)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, least_share: float = 0.01, least_odds: float = 1.5) -> list[Entry]:
    """Words and stems far more frequent in toxic texts of the sample; ``sample`` has ``label, text``.

    A stem is a beginning of four to eight characters that many words share, as long as
    no longer beginning covers nearly as many texts. Terms must be in ``least_share`` of
    the toxic texts and pass a likelihood-ratio test that chance finds in few words. A
    term counts once for each pair of words it stands between, so the copies of one
    toxic text don't make its other words toxic. What clean texts only quote doesn't speak
    against a term; the windows tell quotation from abuse. All terms that pass are kept, which
    the size of the sample bounds: each is in ``least_share`` of its toxic texts.
    """
    own = F.when(F.col("label") == 1, F.col("text")).otherwise(F.regexp_replace("text", QUOTED, " "))
    found = F.regexp_extract_all(F.translate(F.coalesce(own, F.lit("")), LETTERS, LETTERS.lower()), F.lit(WORD_PATTERN), F.lit(0))
    begin = lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w) - 1, F.lit(8))), lambda n: F.substring(w, F.lit(1), n))
    each = sample.select("label", found.alias("line")).withColumn("words", F.array_distinct("line"))
    begins = F.array_distinct(F.flatten(F.transform(F.filter("words", lambda w: F.length(w) > 4), begin)))
    listed = each.select("label", F.explode("words").alias("term"), F.lit(False).alias("stem")).unionAll(
        each.select("label", F.explode(begins).alias("term"), F.lit(True).alias("stem"))
    )
    counts = listed.groupBy("term", "stem").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    least = max(5, math.ceil(least_share * n_toxic))
    base = n_toxic / (n_toxic + n_clean)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("n") - F.col("toxic") + 0.5) / (n_clean + 1)))
    kept = counts.filter((F.col("toxic") >= least) & (odds >= least_odds) & (F.length("term") >= 3))
    kept = written_once(kept, "toxic-terms")
    beside = lambda i: F.xxhash64(F.get("line", i - 1), F.get("line", i + 1))
    words = F.transform("line", lambda w, i: F.struct(w.alias("word"), beside(i).alias("around")))
    place = each.filter("label = 1").select(F.explode(words).alias("w")).select("w.*")  # the line itself stays behind
    parts = F.when(F.length("word") > 4, begin(F.col("word"))).otherwise(F.array().cast("array<string>"))
    terms = F.concat(
        F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))),
        F.transform(parts, lambda t: F.struct(t.alias("term"), F.lit(True).alias("stem"))),
    )
    spread = place.select("around", F.explode(terms).alias("t")).select("around", "t.*")
    contexts = spread.join(kept, ["term", "stem"], "left_semi").groupBy("term", "stem").agg(F.count_distinct("around").alias("contexts"))
    contexts = contexts.filter(F.col("contexts") >= least)
    rows = []
    for r in kept.join(contexts, ["term", "stem"]).collect():
        toxic, clean = min(r["toxic"], r["contexts"]), r["n"] - r["toxic"]
        n = toxic + clean
        surprise = 2 * (toxic * math.log(toxic / (n * base)) + (clean * math.log(clean / (n * (1 - base))) if clean else 0))
        if toxic >= least and surprise >= 20:
            rows.append({"term": r["term"], "stem": r["stem"], "toxic": toxic})
    whole = {r["term"]: r["toxic"] for r in rows if not r["stem"]}
    stems = {r["term"]: r["toxic"] for r in rows if r["stem"]}
    chosen: dict[str, int] = {}
    for stem in sorted(stems, key=lambda s: (len(s), s)):
        if any(stem.startswith(c) for c in chosen):
            continue
        longest = max([0, *(n for w, n in whole.items() if w.startswith(stem))])
        if stems[stem] < 1.3 * longest:
            continue  # one word makes up the stem
        best = stem
        for longer in sorted((s for s in stems if s.startswith(stem)), key=len):
            if stems[longer] >= 0.95 * stems[stem]:
                best = longer
        chosen[best] = stems[best]
    entries = [(n, Entry(t, True)) for t, n in chosen.items()]
    entries += [(n, Entry(t, False)) for t, n in whole.items() if not any(t.startswith(c) for c in chosen)]
    return [e for _, e in sorted(entries, key=lambda x: (-x[0], x[1].term))]


def _scan(rows: DataFrame, automaton: Automaton, kind: str) -> DataFrame:
    """``id, label, matches`` of rows ``id, label, text``."""
    ddl = f"id {kind}, label int, matches {MATCHES}"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)

    def scan(batches):
        scanner = Scanner(automaton)
        for batch in batches:
            for lo, found in scanner.matches(batch.column("text")):
                n = len(found)
                columns = [batch.column("id").slice(lo, n), batch.column("label").slice(lo, n), pa.array(found, schema.field("matches").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("id", "label", "text").mapInArrow(scan, ddl)


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Newton steps for the log loss, held near a prior where the data say nothing."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge / 50 * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge / 50 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return w


#: Bias, strongest window, sum of windows, strongest quotation, strongest address, distinct terms.
PRIOR = np.array([-3.0, 1.0, 0.5, 0.1, 0.3, 0.5])


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 4000,
) -> Model:
    """Learn lexicon, term weights and window weights on a bounded sample.

    The sample is at most ``per_class`` labelled whole texts of each label, chosen by
    the hash of the id. Without toxic texts the lexicon is empty and scores stay low.
    """
    chosen = bounded_sample(labels.filter(usable), id_col, per_class, label_col).withColumnRenamed("id", "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = written_once(
        texts.join(F.broadcast(chosen), texts["id"] == chosen["chosen"]).select("id", F.col("label").cast("int").alias("label"), "text"),
        "toxic-sample",
    )
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    entries = learn_lexicon(sample, n_toxic, n_clean) if n_toxic and n_clean else []
    model = Model(entries, Automaton(entries), np.zeros((3, len(entries))), PRIOR.copy())
    if not entries:
        return model
    kind = sample.schema["id"].dataType.simpleString()
    found = sorted(_scan(sample, model.automaton, kind).select("label", "matches").collect(), key=str)
    y = np.array([r["label"] for r in found], float)
    rows = [[m.asDict() for m in r["matches"]] for r in found]
    for edits, weights in enumerate(model.by_edits):
        holds, mentions = np.zeros((2, len(entries))), np.zeros((2, len(entries)))
        for label, matches in zip(y, rows):
            for entry in {m["entry"] for m in matches if m["edits"] == edits and not m["quoted"]}:
                holds[int(label), entry] += 1
            for entry in {m["entry"] for m in matches if m["edits"] == edits}:
                mentions[int(label), entry] += 1
        holds = np.where(holds[1] > 0, holds, mentions)  # a term that toxic texts only quote counts there too
        rate = (holds + 0.5) / (np.array([[n_clean], [n_toxic]]) + 1)
        odds = np.log(rate[1] / rate[0])
        weights[:] = odds
        if edits:  # a misspelling nobody wrote is trusted less than the term
            weights[:] = np.where(holds.sum(axis=0) > 0, odds, (1 - 0.22 * edits) * model.by_edits[0])
        weights[:] = np.clip(weights, 0, 6)
    model.weights = _logistic(np.array([model.features(m) for m in rows]), y, PRIOR)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, n_matches`` for every whole text, in one narrow pass; null is an empty text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def apply(batches):
        scanner = Scanner(model.automaton)
        empty = model.score([])
        for batch in batches:
            scores, counts = np.full(batch.num_rows, empty), np.zeros(batch.num_rows, np.int64)
            for lo, found in scanner.matches(batch.column("text")):
                for i, matches in enumerate(found):
                    if matches:
                        scores[lo + i], counts[lo + i] = model.score(matches), len(matches)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array(counts)], names=["id", "score", "n_matches"])

    return rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, score double, n_matches long")
