"""Text quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foreglass.llm.sampling import bounded_sample
from foreglass.llm.words import SLICE_BYTES, Words, row_slices, text_buffer

PASSAGE_WORDS = 48
_CLASSES = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "symbol": [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-"],
    "line": [10, 13],
    "foreign": list(range(128, 256)),
}
N_FEATURES = len(_CLASSES) + 13


def _class_tables() -> np.ndarray:
    tables = np.zeros((len(_CLASSES), 256), dtype=np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        tables[i, members] = 1
    return tables


def _within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ranges."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return (sums[hi] - sums[lo]).astype(np.float32)


class Passages:
    """Encodes every run of ``PASSAGE_WORDS`` words of a text by what its words look like."""

    def __init__(self) -> None:
        self.words = Words(lower=False)
        self.tables = _class_tables()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of all passages of the rows, and per row the number of its first passage."""
        starts, ends, first = self.words.spans(data, offsets)
        hashes = self.words.hash(data, starts, ends)
        n_words = np.diff(first)
        n_passages = -(-n_words // PASSAGE_WORDS)
        head = np.concatenate([[0], np.cumsum(n_passages)])
        total = int(head[-1])
        row = np.repeat(np.arange(len(n_words)), n_passages)
        lo = first[row] + PASSAGE_WORDS * (np.arange(total) - head[row])
        hi = np.minimum(lo + PASSAGE_WORDS, first[row + 1])
        if not total:
            return np.zeros((0, N_FEATURES), np.float32), head
        n = (hi - lo).astype(np.float32)
        begin, end = starts[lo], ends[hi - 1]
        size = (end - begin).astype(np.float32)
        out = np.zeros((total, N_FEATURES), np.float32)
        for i, table in enumerate(self.tables):
            flags = table[data]
            out[:, i] = _within(flags, begin, end) / size
        length = (ends - starts).astype(np.int64)
        at = len(self.tables)
        mean = _within(length, lo, hi) / n
        spread = np.sqrt(np.maximum(0, _within(length * length, lo, hi) / n - mean * mean))
        last = data[ends - 1]
        initial = data[starts]
        is_symbol = self.tables[4][last] > 0
        alone = (length == 1) & is_symbol
        loud = (self.tables[0][initial] > 0) & (length > 1) & (self.tables[0][data[np.minimum(starts + 1, len(data) - 1)]] > 0)
        word_flags = [alone, is_symbol & ~alone, loud, self.tables[2][initial] > 0, length <= 3, length >= 14]
        for back in (1, 2, 3):
            same = np.zeros(len(hashes), bool)
            same[back:] = hashes[back:] == hashes[:-back]
            word_flags.append(same)
        out[:, at] = np.minimum(mean, 40) / 10
        out[:, at + 1] = np.minimum(spread, 40) / 10
        for i, flags in enumerate(word_flags):
            out[:, at + 2 + i] = _within(flags, lo, hi) / n
        out[:, at + 11] = np.log1p(n) / 4
        group = np.repeat(np.arange(total), hi - lo)
        order = np.lexsort((hashes, group))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (group[order][1:] != group[order][:-1])
        out[:, at + 12] = np.bincount(group[order][new], minlength=total) / n
        return out, head


@dataclass
class Model:
    """Encoder, gated attention and classifier, with the standardisation of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _forward(x: np.ndarray, head: np.ndarray, w: dict[str, np.ndarray]) -> tuple:
    """Scores of bags of passages; ``head`` has the first passage of each bag, none empty."""
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    t, g = np.tanh(h @ w["att"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    raw = (t * g) @ w["pick"]
    sizes = np.diff(head)
    raw = raw - np.repeat(np.maximum.reduceat(raw, head[:-1]), sizes)
    e = np.exp(raw)
    a = e / np.repeat(np.add.reduceat(e, head[:-1]), sizes)
    z = np.add.reduceat(a[:, None] * h, head[:-1], axis=0)
    return h, t, g, a, z, z @ w["out"] + w["out_b"]


def probability(x: np.ndarray, head: np.ndarray, model: Model) -> np.ndarray:
    """Probability of label 1 for each text; one without words gets the empty representation."""
    scores = np.full(len(head) - 1, model.weights["out_b"][0], np.float64)
    some = np.flatnonzero(np.diff(head) > 0)
    if len(some):
        starts = np.append(head[:-1][some], head[-1])
        scores[some] = _forward((x - model.mean) / model.scale, starts, model.weights)[5]
    return 1 / (1 + np.exp(-scores))


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 40, rate: float = 0.01) -> Model:
    """Adam on the mean log loss of the documents; passages have no labels of their own."""
    rng = np.random.RandomState(5)
    everything = np.concatenate(bags)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    normal = lambda *shape: (rng.randn(*shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {
        "enc": normal(len(mean), hidden),
        "enc_b": np.zeros(hidden, np.float32),
        "att": normal(hidden, attention),
        "gate": normal(hidden, attention),
        "pick": normal(attention),
        "out": normal(hidden),
        "out_b": np.array([np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))], np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x = np.concatenate([bags[i] for i in rows])
            head = np.concatenate([[0], np.cumsum([len(bags[i]) for i in rows])])
            h, t, g, a, z, score = _forward(x, head, w)
            error = ((1 / (1 + np.exp(-score)) - labels[rows]) / len(rows)).astype(np.float32)
            sizes = np.diff(head)
            dz = np.repeat(error[:, None] * w["out"], sizes, axis=0)
            da = (dz * h).sum(axis=1)
            draw = a * (da - np.repeat(np.add.reduceat(a * da, head[:-1]), sizes))
            dt, dg = draw[:, None] * w["pick"] * g * (1 - t * t), draw[:, None] * w["pick"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ w["att"].T + dg @ w["gate"].T) * (1 - h * h)
            grads = {
                "enc": x.T @ dh,
                "enc_b": dh.sum(axis=0),
                "att": h.T @ dt,
                "gate": h.T @ dg,
                "pick": (draw[:, None] * t * g).sum(axis=0),
                "out": z.T @ error,
                "out_b": np.array([error.sum()], np.float32),
            }
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, grad in grads.items():
                grad = grad + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w[k] = (w[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w)


def _encoded(column: pa.Array, passages: Passages) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(column)
    for lo, hi in row_slices(offsets):
        part = offsets[lo : hi + 1]
        text = data[part[0] : part[-1]]
        if len(text) <= 2 * SLICE_BYTES:
            x, head = passages.encode(text, part - part[0])
        else:  # one long text: passages start anew at every piece of some MB
            x = np.concatenate([passages.encode(text[a:b], np.array([0, b - a]))[0] for a, b in passages.words.pieces(text)])
            head = np.array([0, len(x)])
        yield lo, x, head


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 3000,
) -> Model | None:
    """Fit on at most ``per_class`` whole labelled texts of each label, by the hash of the id.

    Tasks encode the chosen texts; the driver gets some twenty numbers per passage.
    None if no labelled text has words.
    """
    chosen = bounded_sample(labels.filter(usable), id_col, per_class, label_col).withColumnRenamed("id", "chosen")

    def features(batches):
        passages = Passages()
        for batch in batches:
            for lo, x, head in _encoded(batch.column("text"), passages):
                packed = [x[a:b].tobytes() for a, b in zip(head, head[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, len(packed)), batch.column("label").slice(lo, len(packed)), pa.array(packed, pa.binary())],
                    names=["id", "label", "bag"],
                )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["id"] == chosen["chosen"]).select("id", F.col("label").cast("int").alias("label"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(features, f"id {kind}, label int, bag binary").toArrow().to_pylist()
    found = sorted((r for r in found if r["bag"]), key=lambda r: (r["id"], r["label"], r["bag"]))
    if not found:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in found]
    return fit(bags, np.array([r["label"] for r in found], np.float32))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``id, score`` for every whole text, in one narrow pass.

    A text without words, or null, gets the score of an empty representation; without a
    model every score is 0.5. The columns named in ``carry`` come along as a struct
    ``carried``.
    """
    carried = F.struct(*carry).alias("carried") if carry else F.lit(0).alias("carried")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried)
    shape = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("carried", rows.schema["carried"].dataType)]
    )

    def apply(batches):
        passages = Passages()
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            for lo, x, head in _encoded(batch.column("text"), passages) if model else ():
                scores[lo : lo + len(head) - 1] = probability(x, head, model)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), batch.column("carried")], names=["id", "score", "carried"])

    scored = rows.mapInArrow(apply, shape)
    return scored if carry else scored.drop("carried")
