"""Language of texts: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foreglass.llm.sampling import bounded_sample
from foreglass.llm.words import SLICE_BYTES, lowered, text_buffer

ORDERS = (2, 3, 4)
_LETTERS = lowered()
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32


@dataclass
class Model:
    """``table`` is embeddings times softmax weights: what a subword adds to each language's logit."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def bucket_counts(data: np.ndarray, counts: np.ndarray, bits: int) -> None:
    """Add the subwords of one text: hashed byte n-grams with blanks for all that is no letter."""
    for lo in range(0, len(data), SLICE_BYTES):
        part = _LETTERS[data[lo : lo + SLICE_BYTES + ORDERS[-1] - 1]].astype(np.uint32)
        rest = len(data) - lo
        gram = part.copy()
        for n in range(2, ORDERS[-1] + 1):
            gram = gram[:-1] | (part[n - 1 :] << np.uint32(8 * (n - 1))) if len(part) >= n else gram[:0]
            if n in ORDERS and len(gram):
                own = gram[: min(SLICE_BYTES, rest)]
                places = (own * np.uint32(2654435761) + np.uint32(n * 40503 * 65537 & 0xFFFFFFFF)) >> np.uint32(32 - bits)
                counts += np.bincount(places, minlength=len(counts))


def frequencies(column: pa.Array, bits: int, block: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of subword shares) for blocks of rows of a text column."""
    data, offsets = text_buffer(column)
    for lo in range(0, len(offsets) - 1, block):
        hi = min(lo + block, len(offsets) - 1)
        shares = np.zeros((hi - lo, 1 << bits), np.float32)
        for row in range(lo, hi):
            counts = np.zeros(1 << bits, np.int64)
            bucket_counts(data[offsets[row] : offsets[row + 1]], counts, bits)
            shares[row - lo] = counts / max(1, counts.sum())
        yield lo, shares


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(shares: np.ndarray, labels: np.ndarray, languages: list[str], dims: int = 16, steps: int = 1500, rate: float = 0.5) -> Model:
    """Stochastic gradient descent; a fifth of the rows calibrates temperature and rejection."""
    rng = np.random.RandomState(3)
    order = rng.permutation(len(labels))
    held = order[: len(order) // 5]
    own = order[len(order) // 5 :]
    scale = 1 / (np.sqrt((shares[own] ** 2).mean(axis=0)) + 1e-4)
    scale /= np.sqrt(len(scale))
    embed = rng.uniform(-1, 1, (shares.shape[1], dims)).astype(np.float32) / dims
    weight = np.zeros((dims, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    truth = np.eye(len(languages), dtype=np.float32)[labels]
    epochs = max(30, -(-steps * 32 // len(own)))  # a small sample is gone through more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        mixed = rng.permutation(own)
        for at in range(0, len(mixed), 32):
            rows = mixed[at : at + 32]
            x = shares[rows] * scale
            hidden = x @ embed
            error = (softmax(hidden @ weight + bias) - truth[rows]) / len(rows)
            back = error @ weight.T
            weight -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            embed -= step * x.T @ back
    table = (scale[:, None] * (embed @ weight)).astype(np.float32)
    check = held if len(held) else own
    logits, answer = shares[check] @ table + bias, labels[check]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), answer] + 1e-9).mean()
    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    sure = softmax(logits / temperature)
    best, right = sure.max(axis=1), sure.argmax(axis=1) == answer
    threshold = next(_thresholds(best, right), 1.0)
    return Model(languages, table, bias, float(temperature), threshold)


def _thresholds(best: np.ndarray, right: np.ndarray, goal: float = 0.99) -> Iterator[float]:
    """Scores from which on at least ``goal`` of the accepted calibration rows are right."""
    for t in np.linspace(0, 0.99, 100):
        kept = right[best >= t]
        if len(kept) == 0 or kept.mean() >= goal:
            yield float(t)


def train(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = 500, most: int = 4000, bits: int = 13
) -> Model | None:
    """Fit on at most ``per_class`` whole texts of each language and ``most`` in all, chosen by the hash of the id.

    Tasks send a vector of ``2**bits`` subword shares for each chosen text, so the driver
    holds a bounded matrix. None if there are no labelled rows.
    """
    chosen = bounded_sample(docs.filter(usable), id_col, per_class, label_col, most).withColumnRenamed("id", "chosen")

    def features(batches):
        for batch in batches:
            for lo, shares in frequencies(batch.column("text"), bits):
                packed = [row.tobytes() for row in (shares * 1024).astype(np.float16)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(lo, len(packed)), pa.array(packed, pa.binary())], names=["label", "shares"]
                )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["id"] == chosen["chosen"]).select("label", "text").mapInArrow(features, "label string, shares binary")
    found = rows.toArrow()
    if not found.num_rows:
        return None
    labels = np.array(found.column("label").to_pylist())
    shares = np.stack([np.frombuffer(b, np.float16) for b in found.column("shares").to_pylist()]).astype(np.float32) / 1024
    order = np.lexsort((shares[:, 0], shares[:, 1], shares[:, 2], labels))  # tasks may answer in any order
    languages = sorted(set(labels))
    return fit(shares[order], np.searchsorted(languages, labels[order]), languages)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, accepted`` for whole texts, in one narrow pass.

    ``score`` is the calibrated probability of the named language; ``accepted`` is false
    where it is below the score from which 99 % of the calibration rows were right.
    A null text, or one without letters, is ``und`` with score 0 and not accepted.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    )
    if model is None:
        return rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    bits = int(model.table.shape[0]).bit_length() - 1

    def score(batches):
        for batch in batches:
            names = np.full(batch.num_rows, "und", dtype=object)
            scores = np.zeros(batch.num_rows)
            lettered = np.array(batch.column("lettered").to_pylist(), dtype=bool)
            for lo, shares in frequencies(batch.column("text"), bits):
                sure = softmax((shares @ model.table + model.bias).astype(np.float64) / model.temperature)
                rows_here = slice(lo, lo + len(sure))
                names[rows_here] = np.array(model.languages, dtype=object)[sure.argmax(axis=1)]
                scores[rows_here] = sure.max(axis=1)
            names[~lettered], scores[~lettered] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(scores), pa.array(lettered & (scores >= model.threshold))],
                names=["id", "lang_pred", "score", "accepted"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double, accepted boolean")
