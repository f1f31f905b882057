"""Quality of a document by attention over its passages.

Labels are given for documents, not for passages.  Each passage of 64 words is
encoded, gated attention weighs the passages of a document against each other,
and the weighted mean of their codes is scored.  All weights are learned
together from the documents' labels, in numpy, on a bounded sample; scoring
runs over every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.textbytes import Texts, slices

PASSAGE_WORDS = 64
SAMPLE_DOCS = 8000  # most labelled documents that training sees
CODE, ATTENTION = 32, 16
EPOCHS, BATCH, RATE = 25, 64, 0.004

# The classes of bytes that are counted in a passage.
SIGNS = [".", ",", "!", "?", "|", "$", "#", "%", "&", "*", "@", "/", "\"'`", "<>(){}[]", "-_=+~^\\", ":;"]
LOWER, UPPER, DIGIT, SPACE, BREAK, LEAD, INNER, OTHER = range(8)
CLASSES = 8 + len(SIGNS)
FEATURES = CLASSES + 6


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[ord("a"):ord("z") + 1] = LOWER
    table[ord("A"):ord("Z") + 1] = UPPER
    table[ord("0"):ord("9") + 1] = DIGIT
    table[0x20] = SPACE
    table[0x09:0x0E] = BREAK
    table[0x80:0xC0] = INNER
    table[0xC0:] = LEAD
    for i, signs in enumerate(SIGNS):
        for sign in signs:
            table[ord(sign)] = 8 + i
    return table


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the first passage of each text (one more at the end).

    A text without words has one passage of zeros.
    """
    words = texts.words()
    n_words = words.counts()
    per_text = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per_text)])
    total = int(first[-1])
    text = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(total) - first[text]
    begin = words.first[text] + number * PASSAGE_WORDS
    end = np.minimum(begin + PASSAGE_WORDS, words.first[text + 1])
    size = end - begin
    x = np.zeros((total, FEATURES), np.float32)
    full = size > 0
    if full.any():
        passage = np.repeat(np.arange(total), size)
        lo, hi = words.start[begin[full]], words.end[end[full] - 1]
        held = hi - lo
        at = np.arange(held.sum()) + np.repeat(lo - (np.cumsum(held) - held), held)
        place = np.repeat(np.flatnonzero(full), held) * CLASSES
        counts = np.bincount(place + _class_table()[texts.data[at]], minlength=total * CLASSES).reshape(total, CLASSES)
        x[:, :CLASSES] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        key = (passage.astype(np.uint64) << np.uint64(40)) | (words.hashes() >> np.uint64(24))
        distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=total)
        length = np.bincount(passage, words.end - words.start, minlength=total)
        capital = np.bincount(passage, _class_table()[texts.data[words.start]] == UPPER, minlength=total)
        n = np.maximum(size, 1)
        x[:, CLASSES] = size / PASSAGE_WORDS
        x[:, CLASSES + 1] = length / n / 10
        x[:, CLASSES + 2] = distinct / n
        x[:, CLASSES + 3] = capital / n
        x[:, CLASSES + 4] = np.log1p(n_words[text]) / 10
        x[full, CLASSES + 5] = 1.0
    return x, first


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1], axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Weights by name: encoder (w, b), attention (v, u, t), score (c, d); mean and spread scale the features."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, mean: np.ndarray, spread: np.ndarray, seed: int = 7) -> AttentionModel:
        rng = np.random.default_rng(seed)
        shapes = {"w": (len(mean), CODE), "b": (CODE,), "v": (CODE, ATTENTION), "u": (CODE, ATTENTION), "t": (ATTENTION,), "c": (CODE,), "d": (1,)}
        return cls(mean, spread, {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "wvutc" else np.zeros(s) for k, s in shapes.items()})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ p["w"] + p["b"])
        a, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (a * g) @ p["t"]
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), sizes))
        share = e / np.repeat(_by_text(e, first), sizes)
        z = _by_text(share[:, None] * h, first)
        return {"x": x, "h": h, "a": a, "g": g, "share": share, "z": z, "score": sigmoid(z @ p["c"] + p["d"][0])}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the texts."""
        p, s, sizes = self.weights, self.forward(x, first), np.diff(first)
        h, a, g, share = s["h"], s["a"], s["g"], s["share"]
        err = (s["score"] - y) / len(y)
        dz = np.repeat(err[:, None] * p["c"], sizes, axis=0)
        pull = (dz * h).sum(axis=1)
        de = share * (pull - np.repeat(_by_text(share * pull, first), sizes))
        dag = de[:, None] * p["t"]
        da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
        dh = share[:, None] * dz + da @ p["v"].T + dg @ p["u"].T
        pre = dh * (1 - h * h)
        return {"w": s["x"].T @ pre, "b": pre.sum(axis=0), "v": h.T @ da, "u": h.T @ dg, "t": (a * g).T @ de,
                "c": s["z"].T @ err, "d": err.sum(keepdims=True)}

    def scores(self, texts: Texts) -> np.ndarray:
        return self.forward(*passages(texts))["score"]


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> AttentionModel:
    """Train on one array of passages per document."""
    every = np.concatenate(bags)
    model = AttentionModel.new(every.mean(axis=0), every.std(axis=0) + 1e-3, seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    model.weights["d"][0] = np.log(share / (1 - share))
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, steps = 0, EPOCHS * -(-len(bags) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            rows = order[lo:lo + BATCH]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in rows])])
            found = model.gradients(np.concatenate([bags[i] for i in rows]), first, y[rows])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in found.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                model.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
    return model


def training_rows(doc_id: Column, folds: int = 3, held_out: int = 1) -> Column:
    """Labels that may be learned from; a row without an id may not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != held_out, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(1)):
            x, first = passages(part)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.first, len(part)),
                pa.array([x[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:])], pa.binary()),
            ], names=["doc", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel | None:
    """Fit on at most ``SAMPLE_DOCS`` labelled documents of the allowed folds, chosen by the hash of their id.

    An id with several labels counts by their mean, 1 from one half on.  None when there are no labels.
    """
    known = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("double").alias("y")).filter(
        training_rows(F.col("doc")) & F.col("y").isNotNull())
    chosen = known.groupBy("doc").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_DOCS)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("doc")), "doc", "left_semi")
    kind = texts.schema["doc"].dataType.simpleString()
    bags = texts.mapInArrow(_bags, f"doc {kind}, features binary")
    rows = bags.join(F.broadcast(chosen), "doc").orderBy("doc", F.xxhash64("features")).limit(SAMPLE_DOCS).toArrow()
    if rows.num_rows == 0:
        return None
    found = [np.frombuffer(f, np.float32).reshape(-1, FEATURES) for f in rows["features"].to_pylist()]
    return fit(found, rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: AttentionModel | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``score``, the likelihood of label 1.

    Null and empty texts are scored as one passage of zeros.  Without any label every score is 0.5.
    """
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    if model is None:
        return held.withColumn("score", F.lit(0.5))

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        parts = [model.scores(p) for p in slices(texts)]
        pa.default_memory_pool().release_unused()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return held.withColumn("score", rate(F.col("row")[text_col]))
