"""Sequence tagging: hidden Markov model counts, greedy and Viterbi decoding.

Training is counting. A sentence to decode is one row with its word array; the
transition table goes to every task. The emission scores go along with it while
they are few bytes; beyond that, chunks of sentences look up their words. Sentences of equal
length are decoded together, as array arithmetic over the whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from foreglass.scale import BROADCAST_BYTES, broadcast_if_small, looked_up, small_slices, written_once

OPTIONS = 4_000_000
START, UNKNOWN, FLOOR = "<s>", "< unk >", 1e-9


def transition_table(tokens: DataFrame, sentence: list[str]) -> DataFrame:
    """``(from_tag, to_tag, n, p)`` inside sentences, start mark included."""
    before = F.lag("tag", 1, START).over(Window.partitionBy(*sentence).orderBy("pos"))
    steps = tokens.select(F.col("tag").alias("to_tag"), before.alias("from_tag"))
    return _step_shares(steps.groupBy("from_tag", "to_tag").agg(F.count("*").alias("n")))


def transitions_of_arrays(sentences: DataFrame, tags: str = "tags") -> DataFrame:
    """The same table from one tag array per sentence; only counts are shuffled."""
    tag = F.col(tags)
    steps = F.zip_with(
        F.concat(F.array(F.lit(START)), F.slice(tag, F.lit(1), F.greatest(F.size(tag) - 1, F.lit(0)))),
        tag,
        lambda a, b: F.struct(a.alias("from_tag"), b.alias("to_tag")),
    )
    spread = sentences.filter(F.size(tag) > 0).select(F.explode(steps).alias("s"))
    return _step_shares(spread.groupBy("s.from_tag", "s.to_tag").agg(F.count("*").alias("n")))


def _step_shares(counted: DataFrame) -> DataFrame:
    totals = counted.groupBy("from_tag").agg(F.sum("n").alias("_total"))
    return counted.join(totals, "from_tag").select(
        "from_tag", "to_tag", "n", (F.col("n") / F.col("_total")).alias("p")
    )


def emission_table(tokens: DataFrame, threshold: int | None = None) -> DataFrame:
    """``(tag, word, n, p)``: share of the word among all words of the tag.

    With a threshold, words seen at most that often are folded into the unknown
    mark. Folding works on the counts, never on the tokens.
    """
    counted = tokens.groupBy("tag", "word").agg(F.count("*").alias("n"))
    if threshold is not None:
        seen = counted.groupBy("word").agg(F.sum("n").alias("_seen"))
        folded = F.when(F.col("_seen") > threshold, F.col("word")).otherwise(F.lit(UNKNOWN))
        counted = counted.join(seen, "word").groupBy("tag", folded.alias("word")).agg(F.sum("n").alias("n"))
    totals = counted.groupBy("tag").agg(F.sum("n").alias("_total"))
    return counted.join(broadcast_if_small(totals), "tag").select(
        "tag", "word", "n", (F.col("n") / F.col("_total")).alias("p")
    )


def best_paths(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most probable tag numbers of equally long sentences (log scores; ties: smallest).

    ``emit`` is (sentences, words, tags).
    """
    score = start + emit[:, 0]
    back = []
    for place in range(1, emit.shape[1]):
        options = score[:, :, None] + step
        back.append(options.argmax(axis=1))
        score = options.max(axis=1) + emit[:, place]
    path = [score.argmax(axis=1)]
    every = np.arange(len(emit))
    for pointers in reversed(back):
        path.append(pointers[every, path[-1]])
    return np.stack(path[::-1], axis=1)


def greedy_paths(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tag for each word given the tag chosen before it."""
    path = [(start + emit[:, 0]).argmax(axis=1)]
    for place in range(1, emit.shape[1]):
        path.append((step[path[-1]] + emit[:, place]).argmax(axis=1))
    return np.stack(path, axis=1)


DECODERS = {"viterbi": best_paths, "greedy": greedy_paths}


class _Model:
    """Transition scores, start scores and the scores of an unknown word, as arrays."""

    def __init__(self, transitions: DataFrame, emissions: DataFrame):
        table = transitions.select("from_tag", "to_tag", "p").collect()  # tags are an alphabet, not data
        self.tags = sorted({r["to_tag"] for r in table})
        self.number = {t: i for i, t in enumerate(self.tags)}
        size = len(self.tags)
        self.step = np.full((size, size), np.log(FLOOR))
        self.start = np.full(size, np.log(FLOOR))
        self.unknown = np.full(size, np.log(FLOOR))
        for r in table:
            to = self.number[r["to_tag"]]
            if r["from_tag"] == START:
                self.start[to] = np.log(r["p"])
            elif r["from_tag"] in self.number:
                self.step[self.number[r["from_tag"]], to] = np.log(r["p"])
        for r in emissions.filter(F.col("word") == UNKNOWN).select("tag", "p").collect():
            if r["tag"] in self.number:
                self.unknown[self.number[r["tag"]]] = np.log(r["p"])


def decode(
    sentences: DataFrame,
    keys: list[str],
    transitions: DataFrame,
    emissions: DataFrame,
    method: str = "viterbi",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(keys, pos, word, predicted_tag)`` for rows ``(keys, words)``, as ``decoded_arrays`` finds them."""
    done = decoded_arrays(sentences, keys, transitions, emissions, method, max_bytes)
    spread = done.select(*keys, F.posexplode(F.arrays_zip("words", "predicted")).alias("pos", "_t"))
    return spread.select(*keys, "pos", F.col("_t.words").alias("word"), F.col("_t.predicted").alias("predicted_tag"))


def decoded_arrays(
    sentences: DataFrame,
    keys: list[str],
    transitions: DataFrame,
    emissions: DataFrame,
    method: str = "viterbi",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(keys, words, predicted)`` for rows ``(keys, words)``; sentences without words are left out.

    Words without emissions are scored as the unknown mark if the model has one;
    missing pairs count ``1e-9``. Every sentence starts from the start mark. Emission
    scores of few bytes (as words x tags) go to the tasks; of more, each chunk of sentences
    gets those of its own words. Every row is a sentence of its own either way, also if keys repeat.
    """
    if method not in DECODERS:
        raise ValueError(f"unknown decoder {method}")
    emissions = written_once(emissions.select("tag", "word", "p"), "emissions")  # counted once, and read three times
    walk, model = DECODERS[method], _Model(transitions, emissions)
    emissions = emissions.withColumn("p", F.ln("p"))
    words = emissions.agg(F.count_distinct("word"), F.sum(F.octet_length("word"))).first()
    rows = sentences.select(*keys, "words").filter(F.size("words") > 0)

    def tagged(batches: Iterator[pa.RecordBatch], known: pa.Table) -> Iterator[pa.RecordBatch]:
        names, (vocabulary, scores) = pa.array(model.tags), _word_scores(known, model)
        for batch in small_slices(batches, "words", 1 << 20):
            lists = batch.column("words")
            sizes = pc.list_value_length(lists).to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            found = pc.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
            chosen = np.zeros(int(sizes.sum()), dtype=np.int64)
            at_once = max(1, OPTIONS // len(model.tags) ** 2)  # sentences whose options are held together
            for length in np.unique(sizes):
                same = first[sizes == length]
                for some in range(0, len(same), at_once):
                    places = same[some : some + at_once][:, None] + np.arange(length)
                    chosen[places] = walk(scores[found[places]], model.step, model.start)
            offsets = pa.array(np.concatenate([first, [sizes.sum()]]).astype(np.int32))
            predicted = pa.ListArray.from_arrays(offsets, names.take(pa.array(chosen)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], lists, predicted], names=[*keys, "words", "predicted"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    ddl = f"{kinds}, words array<string>, predicted array<string>"
    if words[0] * len(model.tags) * 8 + (words[1] or 0) <= max_bytes:
        shared = sentences.sparkSession.sparkContext.broadcast(emissions.toArrow())
        return rows.mapInArrow(lambda batches: tagged(batches, shared.value), ddl)
    per_word = emissions.groupBy("word").agg(F.collect_list(F.struct("tag", "p")).alias("scores"))

    def chunk(part: pa.Table, found: pa.Table) -> pa.Table:
        scores = found.column("scores").combine_chunks()
        times = pc.list_value_length(scores).to_numpy(zero_copy_only=False)
        word = found.column("word").combine_chunks().take(pa.array(np.repeat(np.arange(len(times)), times)))
        flat = scores.flatten()
        known = pa.table({"tag": flat.field("tag"), "word": word, "p": flat.field("p")})
        return pa.Table.from_batches(tagged(part.select([*keys, "words"]).to_batches(), known))

    return looked_up(rows, "words", "word", per_word, chunk, ddl)


def _word_scores(known: pa.Table, model: _Model) -> tuple[pa.Array, np.ndarray]:
    """Words, and their scores as words x tags; row -1 serves every word that is not in the list."""
    word = known.column("word").combine_chunks().cast(pa.string())
    vocabulary = word.unique()
    scores = np.full((len(vocabulary) + 1, len(model.tags)), np.log(FLOOR))
    scores[-1] = model.unknown
    at = pc.index_in(word, value_set=vocabulary).to_numpy(zero_copy_only=False)
    tag = pc.index_in(known.column("tag").combine_chunks(), value_set=pa.array(model.tags, pa.string()))
    which = tag.fill_null(-1).to_numpy(zero_copy_only=False)
    usable = which >= 0
    scores[at[usable], which[usable]] = known.column("p").to_numpy()[usable]
    return vocabulary, scores


def tag_accuracy(predicted: DataFrame, truth: DataFrame, sentence: list[str]) -> DataFrame:
    joined = truth.join(predicted.select(*sentence, "pos", "predicted_tag"), [*sentence, "pos"], "left")
    hit = F.col("tag").eqNullSafe(F.col("predicted_tag")).cast("double")
    return joined.agg(F.count("*").alias("tokens"), F.avg(hit).alias("accuracy"))


def array_accuracy(decoded: DataFrame, tags: str = "tags") -> DataFrame:
    """``tokens, accuracy`` of rows that hold ``predicted`` beside the true tags; nothing but sums is shuffled."""
    hits = F.zip_with(tags, "predicted", lambda a, b: a.eqNullSafe(b).cast("int"))
    found = decoded.select(F.size(tags).cast("bigint").alias("n"), F.aggregate(hits, F.lit(0), lambda s, x: s + x).alias("hits"))
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), (F.sum("hits") / F.sum("n")).alias("accuracy"))
