"""Language of a text: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords, byte runs of three and
four, hashed into a fixed number of rows.  Embeddings and softmax are trained
by stochastic gradient descent in numpy on a bounded sample; a part of the
sample is held back to calibrate the scores and the rejection.

The largest share of a softmax says which language is likeliest, not that it is
one of them.  So a text is also rejected if its subwords are unfamiliar: the
mean of log(share of the subword in texts of the named language / even share).
Scores and familiarity have floors that fall with the number of subwords.  They
are set by the held-back texts, whole and cut to several lengths, that are
named rightly; there is no other limit.  A text without a subword, that is of
fewer than three bytes, cannot be told and is not rejected if it has a letter.

Since the softmax is linear, embedding row times weights is one small table of
logits for each subword, which is all a task needs to score whole texts; the
familiarity of subwords stands beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.textbytes import SPACE, Texts, slices

SHIFT = 20  # bits of a 32-bit hash that are not used
BUCKETS = 1 << (32 - SHIFT)
DIMENSIONS = 16
RUNS = (3, 4)  # lengths of the subwords in bytes
SAMPLE_DOCS = 3000  # most documents that training sees, shared evenly by the languages
SLICES = 64
EPOCHS, BATCH, RATE = 40, 32, 20.0
CALIBRATION_SHARE = 5  # one in so many sample documents is held back
EVEN = 0.1  # weight of even shares beside those of a language's subwords
STRETCH = 256  # bytes in the middle of a text that are cut to shorter ones
CUTS = (3, 4, 6, 8, 16, 32, 64, 128, 256)  # their lengths
CUT_AWAY = 0.01  # share of the cuts of a length below its floor: some hold only numbers or signs
STEPS = 11  # floors for up to 1, 2, 4, ... subwords; the last one for all longer texts
TOWARDS_EVEN = 0.25  # how far the floor of familiarity lies from the lowest one towards that of even shares
UNKNOWN = "und"


def _letters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[ord("A"):ord("Z") + 1] += 32
    table[SPACE] = 32
    return table


def subwords(texts: Texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length: the bucket of every subword, and where each text's begin (one more place at the end).

    White space counts as one space.  A text shorter than a run has none of that length.
    """
    data = _letters()[texts.data]
    edges = texts.offsets
    found, where = [], []
    for n in RUNS:
        count = max(0, len(data) - n + 1)
        h = np.full(count, n, np.uint32)
        for k in range(n):
            h = (h ^ data[k:k + count]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        inside = np.ones(count, bool)
        for e in range(1, n):  # not across the end of a text
            cut = edges[1:-1] - e
            inside[cut[(cut >= 0) & (cut < count)]] = False
        at = np.flatnonzero(inside)
        found.append(((h[at] * np.uint32(0x85EBCA6B)) >> np.uint32(SHIFT)).astype(np.int32))
        where.append(at)
    return found, [np.searchsorted(at, edges) for at in where]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between consecutive starts; an empty stretch sums to 0."""
    out = np.zeros((len(starts) - 1, values.shape[1]))
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embedding times weights
    bias: np.ndarray
    temperature: float
    familiar: np.ndarray  # (BUCKETS, languages): log(share / even share)
    floors: np.ndarray  # (STEPS, 2): of score and familiarity by number of subwords

    def judge(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the likeliest language, its score, and whether the text is rejected."""
        k = len(self.languages)
        table = np.concatenate([self.logits, self.familiar], axis=1)
        total, n = np.zeros((len(texts), 2 * k)), np.zeros(len(texts))
        for found, starts in zip(*subwords(texts)):
            total += _sums(table[found], starts)
            n += np.diff(starts)
        total /= np.maximum(n, 1)[:, None]
        p = softmax((total[:, :k] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score, familiar = p.max(axis=1), total[np.arange(len(texts)), k + best]
        floor = self.floors[step_of(n)]
        return best, score, (n > 0) & ((score < floor[:, 0]) | (familiar < floor[:, 1]))


def step_of(n: np.ndarray) -> np.ndarray:
    """The place of the floors for so many subwords."""
    return np.minimum(np.ceil(np.log2(np.maximum(n, 1))).astype(int), STEPS - 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_rows(doc_id: Column, folds: int = 4, held_out: int = 2) -> Column:
    """Rows that may be learned from; a row without an id may not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != held_out, F.lit(False))


def sample(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``most`` documents with a language, chosen by the hash of their id, evenly over the languages."""
    named = docs.filter(allowed & F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN))
    known = named.select(F.col(id_col).alias("doc"), F.col(lang_col).alias("lang"))
    n = max(1, known.agg(F.count_distinct("lang")).first()[0])
    each = max(1, most // n)
    known = known.withColumn("order", F.xxhash64("doc")).withColumn("slice", F.pmod("order", F.lit(SLICES)))
    for by in (["lang", "slice"], ["lang"]):  # first in slices, as a language may hold most documents
        first = Window.partitionBy(*by).orderBy("order", "doc")
        known = known.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= each)
    chosen = known
    chosen = chosen.orderBy("place", "lang").limit(most).select("doc").distinct()
    texts = named.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return texts.join(F.broadcast(chosen), "doc", "left_semi")  # at most SAMPLE_DOCS ids


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(1)):
            rows, middles, (found, starts) = [], [], subwords(part)
            for i in range(len(part)):
                runs = [f[s[i]:s[i + 1]] for f, s in zip(found, starts)]
                bucket, count = np.unique(np.concatenate(runs), return_counts=True)
                rows.append(np.stack([bucket, count]).astype("<u4").tobytes())
                held = min(len(runs[0]), STRETCH - RUNS[0] + 1)
                lo = (len(runs[0]) - held) // 2
                middles.append(np.concatenate([runs[0][lo:lo + held], runs[1][lo:lo + max(held - 1, 0)]]).astype(np.int16).tobytes())
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.first, n), batch.column(2).slice(part.first, n), pa.array(rows, pa.binary()), pa.array(middles, pa.binary())],
                names=["doc", "lang", "counts", "middle"])


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on a bounded sample; None when no document may be learned from."""
    chosen = sample(docs, allowed, id_col, text_col, lang_col)
    kind = chosen.schema["doc"].dataType.simpleString()
    rows = chosen.mapInArrow(_histograms, f"doc {kind}, lang string, counts binary, middle binary")
    table = rows.orderBy("doc", F.xxhash64("counts")).limit(SAMPLE_DOCS).toArrow()
    if table.num_rows == 0:
        return None
    names, counts = table["lang"].to_pylist(), table["counts"]
    middles = [np.frombuffer(v, np.int16) for v in table["middle"].to_pylist()]
    x = np.zeros((table.num_rows, BUCKETS), np.float32)
    for i, row in enumerate(counts):
        bucket, count = np.frombuffer(row.as_buffer(), "<u4").reshape(2, -1)
        x[i, bucket] = count
    del table, counts
    total = x.sum(axis=1, keepdims=True)
    full = np.flatnonzero(total)
    if not len(full):
        return None
    x /= np.maximum(total, 1)
    languages = sorted(set(names))
    y = np.array([languages.index(v) for v in names])
    return fit(x, y, languages, full, total[:, 0], middles)


def cut_means(middle: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the pieces of each length of ``CUTS`` in a text's middle: the numbers of subwords, and the means of their rows of ``table``."""
    held = (len(middle) + 1) // 2
    before = [np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[part], axis=0, dtype=float)]) for part in (middle[:held], middle[held:])]
    numbers, means = [np.zeros(0, int)], [np.zeros((0, table.shape[1]))]
    for size in CUTS:
        lo = np.arange(0, max(0, held - (size - RUNS[0])), size)
        total = sum(sums[lo + size - run + 1] - sums[lo] for run, sums in zip(RUNS, before) if size >= run)
        n = sum(size - run + 1 for run in RUNS if size >= run)
        if len(lo):
            numbers.append(np.full(len(lo), n))
            means.append(total / n)
    return np.concatenate(numbers), np.concatenate(means)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rows: np.ndarray, sizes: np.ndarray, middles: list[np.ndarray]) -> LanguageModel:
    """Learn from the given rows of ``x``, shares of subwords; small samples are calibrated on themselves.

    ``sizes`` are the numbers of subwords, ``middles`` those in the middle of each text, in order.
    """
    rng = np.random.default_rng(10)
    order = rng.permutation(rows)
    part = len(order) // CALIBRATION_SHARE if len(order) >= 10 * CALIBRATION_SHARE else 0
    held, learn = (order[:part], order[part:]) if part else (order, order)
    embedding = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * -(-len(learn) // BATCH), 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(learn)
        for lo in range(0, len(shuffled), BATCH):
            rows = shuffled[lo:lo + BATCH]
            mean = x[rows] @ embedding
            error = softmax(mean @ weights + bias).astype(np.float32)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            rate = np.float32(RATE * (1 - step / steps))
            back = error @ weights.T
            weights -= rate * (mean.T @ error)
            bias -= np.float32(0.1) * rate * error.sum(axis=0)
            embedding -= rate * (x[rows].T @ back)
            step += 1
    raw = x[held] @ embedding @ weights + bias
    temperature = _temperature(raw.astype(float), y[held])
    logits = (embedding @ weights).astype(np.float32)
    share = np.stack([x[learn[y[learn] == k]].sum(axis=0, dtype=float) for k in range(len(languages))], axis=1)
    share /= np.maximum(share.sum(axis=0), 1e-12)
    familiar = np.log((share * BUCKETS + EVEN) / (1 + EVEN)).astype(np.float32)
    whole = _measures(raw, x[held] @ familiar, temperature, y[held])
    table, k = np.concatenate([logits, familiar], axis=1), len(languages)
    n, pieces = [], []
    for i in held:  # text by text, so that only two numbers stay of each piece
        number, means = cut_means(middles[i], table)
        n.append(number)
        pieces.append(_measures(means[:, :k] + bias, means[:, k:], temperature, np.full(len(number), y[i])))
    n, pieces = np.concatenate(n), np.concatenate(pieces)
    floors = _floors(sizes[held], whole, n, pieces, float(familiar.mean()))
    return LanguageModel(languages, logits, bias.astype(float), temperature, familiar, floors)


def _measures(raw: np.ndarray, familiar: np.ndarray, temperature: float, y: np.ndarray) -> np.ndarray:
    """Score and familiarity of each text; NaN where it is not named rightly."""
    p = softmax(raw.astype(float) / temperature)
    best = p.argmax(axis=1)
    out = np.stack([p.max(axis=1), familiar[np.arange(len(best)), best]], axis=1)
    out[best != y] = np.nan
    return out


def _floors(sizes: np.ndarray, whole: np.ndarray, cut_sizes: np.ndarray, pieces: np.ndarray, even: float) -> np.ndarray:
    """Below all whole texts and nearly all cuts of so many subwords or more.

    The score's floor is half the lowest one.  That of familiarity goes from the
    lowest a part of the way towards that of evenly drawn subwords.
    """
    low = np.full((STEPS, 2), np.inf)
    for n, values, away in ((sizes, whole, 0.0), (cut_sizes, pieces, CUT_AWAY)):
        known = ~np.isnan(values[:, 0])
        n, values = step_of(n[known]), values[known]
        for k in np.unique(n):
            low[k] = np.minimum(low[k], np.quantile(values[n == k], away, axis=0, method="lower"))
    low = np.minimum.accumulate(low[::-1])[::-1]  # fewer subwords vary more
    seen = np.isfinite(low[:, 0])
    if not seen.any():
        return np.full((STEPS, 2), -np.inf)
    low[~seen] = low[seen][-1]  # longer than any held back
    low[:, 0] *= 0.5
    low[:, 1] -= TOWARDS_EVEN * np.maximum(low[:, 1] - even, 0)
    return low


def _temperature(raw: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which the held-back texts are likeliest."""
    def loss(t: float) -> float:
        p = softmax(raw / t)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    return float(min(np.geomspace(0.2, 5, 41), key=loss))


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``lang_pred``, ``score`` and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and rejected,
    as is every text when there was nothing to learn from.  ``rejected`` also
    holds for texts whose score or familiarity is below its calibrated floor.
    """
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    lettered = held.withColumn("lettered", F.coalesce(F.col("row")[text_col].rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return lettered.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    kind = [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]

    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        judged = [model.judge(part) for part in slices(texts)]
        pa.default_memory_pool().release_unused()
        if not judged:
            return pa.array([], pa.struct(kind))
        names, scores, rejected = (np.concatenate(column) for column in zip(*judged))
        named = pa.array(model.languages, pa.string()).take(pa.array(names))
        return pa.StructArray.from_arrays([named, pa.array(scores), pa.array(rejected)], names=[name for name, _ in kind])

    named = lettered.withColumn("guess", guess(F.col("row")[text_col]))
    return named.select(
        "row",
        F.when(F.col("lettered"), F.col("guess.lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("guess.score")).otherwise(F.lit(0.0)).alias("score"),
        (~F.col("lettered") | F.col("guess.rejected")).alias("rejected"),
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the allowed fold of ``docs`` and name the language of every row."""
    return predict(docs, train(docs, training_rows(F.col(id_col)), id_col, text_col, lang_col), text_col)
