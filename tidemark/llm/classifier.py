"""Quality classifier: attention over the passages of a text, learnt from labels of whole documents.

A text is cut into passages of words. Each is described by a few shares and a hashed bag of its word shapes and
letter pairs, and encoded by a hidden layer. Gated attention (a tanh times a sigmoid, then a softmax over the
text's passages) weighs the encodings, and a logistic unit scores the weighted sum. All weights are learnt
together by gradient descent from the documents' labels alone.

The model is fitted on a bounded sample of the labelled rows, `Settings.sample` at most, drawn by hash. Every
document is scored, with all its passages, in tasks; the model is a few hundred kilobytes whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, pieces

PASSAGE_WORDS = 64
HASHED = 64
SHARES = 11
#: Shares, the hashed bag, and last how much evidence the passage is.
FEATURES = SHARES + HASHED + 1
#: Words that weigh as much as what is known without any: shorter passages count for less.
PRIOR_WORDS = 12
CLIP = 5.0
#: Fixed odd multipliers that tell words apart by their bytes' places.
PLACES = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWEST = np.float32(-4.0)


@dataclass(frozen=True)
class Settings:
    """`sample`: labelled documents to learn from, at most. `hidden`: width. `threshold`: score of a predicted 1."""

    sample: int = 4000
    hidden: int = 24
    epochs: int = 30
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 17
    threshold: float = 0.7


#: Class of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol, 6 sentence mark, 7 beyond ASCII.
CLASSES = np.zeros(256, np.uint8)
for _chars, _class in (
    (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3),
    (b" \t\n\r\x0b\x0c", 4), (b"#*$%&|<>@^~=+{}[]\\/", 5), (b".,;:!?", 6), (bytes(range(128, 256)), 7),
):
    CLASSES[list(_chars)] = _class


def passages(text: str | None) -> np.ndarray:
    """Features (passages, FEATURES) of all passages of a whole text; a text without words is one empty passage."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    kinds = CLASSES[data]
    space = kinds == 4
    word_start = ~space
    word_start[1:] &= space[:-1]
    starts = np.flatnonzero(word_start)
    if not len(starts):
        empty = np.zeros((1, FEATURES), np.float32)
        empty[0, :SHARES] = LOWEST
        return empty
    n_words = len(starts)
    cuts = starts[::PASSAGE_WORDS].copy()
    cuts[0] = 0
    sizes = np.diff(np.append(cuts, len(data)))
    owner = np.repeat(np.arange(len(cuts)), sizes)
    words = np.diff(np.append(np.arange(0, n_words, PASSAGE_WORDS), n_words)).astype(np.float32)
    by_kind = np.bincount(owner * 8 + kinds, minlength=8 * len(cuts)).reshape(-1, 8).astype(np.float32)
    chars = np.maximum(by_kind.sum(axis=1) - by_kind[:, 4], 1)
    # Words equal to the one before.
    firsts = np.append(0, starts)
    place = np.arange(len(data)) - np.repeat(firsts, np.diff(np.append(firsts, len(data))))
    spelt = np.add.reduceat(np.where(space, 0, data.astype(np.uint64) + 1).astype(np.uint64) * PLACES[place & 63], starts)
    again = np.append(False, spelt[1:] == spelt[:-1])
    exclaims = np.bincount(owner[data == 33], minlength=len(cuts)).astype(np.float32)
    lines = np.bincount(owner[data == 10], minlength=len(cuts)).astype(np.float32)
    # Of the words: how many are single characters, and how many begin a run of capitals.
    ends = np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(data))[:n_words]
    of_passage = np.arange(n_words) // PASSAGE_WORDS
    short = np.bincount(of_passage[ends - starts == 1], minlength=len(cuts)).astype(np.float32)
    repeats = np.bincount(of_passage[again], minlength=len(cuts)).astype(np.float32)
    shares = np.stack([
        by_kind[:, 1] / chars, by_kind[:, 2] / chars, by_kind[:, 3] / chars, by_kind[:, 5] / chars,
        by_kind[:, 6] / chars, by_kind[:, 7] / chars, exclaims / words, short / words, lines / words, repeats / words,
        chars / words / 8,
    ], axis=1)
    shares[:, :-1] = np.log(shares[:, :-1] + 0.02)
    # Pairs of letters, hashed; which pairs occur tells languages and gibberish apart.
    low = np.where(kinds == 2, data + 32, data).astype(np.uint32)
    pair = (low[:-1] * 31 + low[1:]) * np.uint32(2654435761)
    bag = np.bincount(owner[:-1] * HASHED + (pair >> 26).astype(np.int64), minlength=HASHED * len(cuts))
    bag = np.sqrt(bag.reshape(-1, HASHED).astype(np.float32) / sizes[:, None])
    evidence = np.sqrt(words / (words + PRIOR_WORDS))[:, None]
    return np.concatenate([np.maximum(shares, LOWEST), bag, evidence], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Hidden encodings, gated attention over each text's passages, and a logistic unit."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray) -> None:
        self.weights, self.mean, self.scale = weights, mean, scale

    @classmethod
    def start(cls, hidden: int, mean: np.ndarray, scale: np.ndarray, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float64)
        weights = {"W": draw(len(mean), hidden), "b": np.zeros(hidden), "V": draw(hidden, hidden),
                   "U": draw(hidden, hidden), "w": draw(hidden) * 0.1, "c": draw(hidden), "d": np.zeros(1)}
        return cls(weights, mean, scale)

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of texts whose passages are `rows`, text by text, from `starts`."""
        p = self.weights
        x = np.clip((rows[:, :-1] - self.mean) / self.scale, -CLIP, CLIP) * rows[:, -1:]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(rows)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z @ p["c"] + p["d"][0], (x, h, t, g, a, z, sizes)

    def gradients(self, rows: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        logits, (x, h, t, g, a, z, sizes) = self.forward(rows, starts)
        delta = weight * (_sigmoid(logits) - y) / weight.sum()
        dz = np.repeat(delta, sizes)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
                "c": z.T @ delta, "d": np.array([delta.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, settings: Settings) -> None:
        """Adam over small batches of texts; both labels weigh the same in all."""
        rng = np.random.default_rng(settings.seed)
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(settings.epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 64):
                chosen = order[at : at + 64]
                rows = np.concatenate([bags[i] for i in chosen])
                starts = np.cumsum([0, *[len(bags[i]) for i in chosen[:-1]]])
                step += 1
                for k, grad in self.gradients(rows, starts, y[chosen], balance[chosen]).items():
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] -= settings.rate * (move + settings.decay * self.weights[k])

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(bags)
        starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
        return _sigmoid(self.forward(rows, starts)[0])


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return crc_mod(id_col, 4) == 2


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> AttentionModel | None:
    """A model of at most `settings.sample` labelled documents that aren't held out, or none without any.

    The sample is drawn by hash of the id, evenly over labels where both are plentiful. Features of all passages of
    the sampled texts are made in tasks; the driver gets those of the sample alone. Conflicting labels of an id each
    count, and rows that repeat an id and its text teach once; of an id's several texts the one of least hash does.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    drawn = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(settings.seed)), "id").limit(settings.sample // 2)
        for y in (0, 1)
    ]
    picked = F.broadcast(drawn[0].unionByName(drawn[1]))  # bounded by the sample's size
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data = [passages(t).astype(np.float32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["id", "y", "bag"])

    # One text for each id, so that the sample's bound holds for rows too; of repeated ids only one row leaves its task.
    sampled = texts.join(picked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text"))
    rows = sampled.join(picked, "id").select("id", "y", "text").mapInArrow(describe, "id long, y int, bag binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["id"], r["y"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, FEATURES) for r in rows]
    y = np.array([r["y"] for r in rows], np.float64)
    every = np.concatenate(bags)[:, :-1]
    model = AttentionModel.start(settings.hidden, every.mean(axis=0), every.std(axis=0) + 0.05, settings.seed)
    model.fit(bags, y, settings)
    return model


def _scorer(model: AttentionModel | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = model.score([passages(t) for t in texts]) if model else np.full(len(texts), 0.5)
            columns = batch.columns[:-1] + [pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score in 0 to 1, predicted.

    Only the text is scored. Null and empty texts are one empty passage. Without any labelled row all scores are
    one half. Repeated ids give a row each; a null id counts as the empty text for `held_out`. Other columns are
    ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, settings, id_col, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(_scorer(model), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """`docs`, with its columns, without the rows that score under the threshold; without labels all rows stay."""
    model = train(docs, labels, settings, id_col, text_col)
    if model is None:
        return docs
    kept = [c for c in docs.columns]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text_col)
        for batch in pieces(batches):
            scores = model.score([passages(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores >= settings.threshold))

    return docs.mapInArrow(keep, docs.schema)
