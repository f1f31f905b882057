"""Near copies among vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; pairs of codewords are
the cells of a grid.  A vector lies in the cell of its two nearest codewords.
For a visiting vector either codebook is put in order of how far the vector is
from the plane that halves the way between a codeword and its own; cells are
visited in order of the sum of both squared distances (multi-sequence).  A
vector that lies in a cell is at least that far away, so by default the walk
stops only where the sum exceeds the distance of two unit vectors at the wanted
cosine: no pair is lost, whatever the vectors are like.  With a target recall it
stops earlier, where that share of made partners at the threshold is found.

Within a cell the product of the first halves, plus that of the lengths of the
second halves, bounds the cosine; pairs that stay below are left out.  What
remains is verified in double precision.

Rows are brought together by label and first codeword, cut into pieces where
many vectors share them, so that a task compares one piece of indexed vectors
with one piece of visitors.  It returns counts and links that span the groups
found, never all pairs.  Vectors that are equal in every component are one
member with a weight.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.blocks import blocks
from panelsmith.llm.components import components
from panelsmith.llm.textbytes import mix
from panelsmith.storage import settle

COSINE = 0.93
SAMPLE = 8192  # most vectors that codebooks, and where to stop, are learned from
SLACK = 1e-9  # for rounding, in squared distance
PIECE = 2048  # vectors of a piece
ROUNDS = 12


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column in double precision, shorter ones filled with zeros."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.float64)
    sizes = np.diff(ends)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, each row's result the same whatever rows it is computed with."""
    step = max(1, (1 << 22) // (centres.size + 1))
    parts = [((x[lo:lo + step, None, :] - centres[None]) ** 2).sum(axis=2) for lo in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(centres)))


def codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size, replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((centres * centres).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
        for j in range(size):
            if (near == j).any():
                centres[j] = x[near == j].mean(axis=0)
    return centres


@dataclass(frozen=True)
class MultiIndex:
    width: int
    half: int
    first: np.ndarray
    second: np.ndarray
    stop: float  # sum of squared distances at which the visits end

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much farther than the nearest each codeword of either half is, in squared distance."""
        a, b = squares(x[:, :self.half], self.first), squares(x[:, self.half:], self.second)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)

    def planes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance of each half from where each codeword of it becomes the nearest; the nearest one's is 0."""
        return tuple(_planes(away, centres) for away, centres in zip(self.distances(x), (self.first, self.second)))


def _planes(away: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = squares(centres, centres)[away.argmin(axis=1)]
    return np.divide(away * away, 4 * gaps, out=np.zeros_like(away), where=gaps > 0)


def reach(cosine: float) -> float:
    """Squared distance of unit vectors at the cosine."""
    return 2 - 2 * cosine + SLACK


def codebook_size(vectors: int) -> int:
    """Cells grow with the number of vectors: about one eighth of its square root codewords on either side."""
    return int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(vectors) / 8))), 2, 256))


def learn(sample: np.ndarray, vectors: int, cosine: float = COSINE, recall: float | None = None) -> MultiIndex:
    """Codebooks from unit vectors, and where visits stop: without loss, or at a target recall of made partners."""
    rng = np.random.default_rng(1)
    width = sample.shape[1]
    half = width - width // 2
    size = min(codebook_size(vectors), len(np.unique(sample, axis=0)))
    first, second = codebook(sample[:, :half], size, rng), codebook(sample[:, half:], size, rng)
    index = MultiIndex(width, half, first, second, reach(cosine))
    if recall is None:
        return index
    sums = []
    ax, bx = index.planes(sample)
    row, own = np.arange(len(sample)), (ax.argmin(axis=1), bx.argmin(axis=1))
    for quiet in (None, slice(half, None), slice(0, half)):  # partners that differ everywhere, or in one half only
        away = rng.normal(size=sample.shape)
        if quiet is not None:
            away[:, quiet] = 0
        away -= (away * sample).sum(axis=1, keepdims=True) * sample
        length = np.sqrt((away * away).sum(axis=1, keepdims=True))
        partner = cosine * sample + np.sqrt(1 - cosine * cosine) * away / np.maximum(length, 1e-12)
        ay, by = index.planes(partner)
        there = ax[row, ay.argmin(axis=1)] + bx[row, by.argmin(axis=1)]
        back = ay[row, own[0]] + by[row, own[1]]
        # A pair in one first codeword is seen from both sides, another from one side only.
        sums.append(np.where(ay.argmin(axis=1) == own[0], np.minimum(there, back), np.maximum(there, back)))
    return MultiIndex(width, half, first, second, min(reach(cosine), float(np.quantile(np.concatenate(sums), recall))))


def depths(a: np.ndarray, b: np.ndarray, stop: float) -> np.ndarray:
    """How many codewords of the second list, nearest first, are visited with each codeword of the first.

    ``a`` and ``b`` have a row of squared distances for each vector.  This is
    where a walk over the cells in order of their sums has come in each row of
    the grid when it stops; for all vectors it is found by one search in each
    sorted second list.
    """
    ordered = np.sort(b, axis=1)
    return np.stack([np.searchsorted(own, stop - ai, "right") for ai, own in zip(a, ordered)]) if len(a) else np.zeros(a.shape, int)


def _linked(x: np.ndarray, y: np.ndarray, half: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with at least the cosine; the second halves are multiplied only where the first leave it open."""
    rest = np.sqrt((x[:, half:] ** 2).sum(axis=1))[:, None] * np.sqrt((y[:, half:] ** 2).sum(axis=1))
    first = x[:, :half] @ y[:, :half].T
    i, j = np.nonzero(first + rest >= cosine - 1e-9)
    if len(i) * 8 > first.size:
        return np.nonzero(first + x[:, half:] @ y[:, half:].T >= cosine)
    some = first[i, j] + (x[i, half:] * y[j, half:]).sum(axis=1) >= cosine
    return i[some], j[some]


def _visits(index: MultiIndex):
    """One row where a vector lies (kind 0) and one for each first codeword with a cell that it visits (kind 1).

    Of two vectors with different first codewords the one with the lower visits the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                x = unit(matrix(batch.column(3), index.width))
                a, b = index.planes(x)
                at = a.argmin(axis=1)
                row, code = np.nonzero((depths(a, b, index.stop) > 0) & (np.arange(len(index.first)) >= at[:, None]))
                kind = np.repeat(np.array([0, 1], np.int32), [len(at), len(row)])
                row, code = np.concatenate([np.arange(len(at)), row]), np.concatenate([at, code])
                taken = batch.take(pa.array(row))
                space = taken.column(1).to_numpy().view(np.uint64)
                key = mix(space + mix(code.astype(np.uint64) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(kind), pa.array(code.astype(np.int32)), *taken.columns],
                    names=["key", "kind", "code", "head", "space", "weight", "embedding", "h1"])

    return run


def _compare(index: MultiIndex, cosine: float):
    """For each block: weights of linked vectors by vector, and links that span what hangs together."""

    def found(block: pa.Table):
        kind, code = block["kind"].to_numpy(), block["code"].to_numpy()
        head, h1, space, weight = (block[c].to_numpy() for c in ("head", "h1", "space", "weight"))
        x = unit(matrix(block["embedding"].combine_chunks(), index.width))
        a, b = index.planes(x)
        cell = (a.argmin(axis=1), b.argmin(axis=1))
        lies, visits = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        pairs = []
        for second in np.unique(cell[1][lies]):
            there = lies[cell[1][lies] == second]
            come = visits[a[visits, code[visits]] + b[visits, second] <= index.stop]
            for lo in range(0, len(come), 1024):
                some = come[lo:lo + 1024]
                i, j = _linked(x[some], x[there], index.half, cosine)
                i, j = some[i], there[j]
                before = (head[i] < head[j]) | (head[i] == head[j]) & (h1[i] < h1[j])
                own = (space[i] == space[j]) & (before | (cell[0][i] != cell[0][j]))  # seen from both sides in one first codeword
                pairs.append((i[own], j[own]))
        none = np.zeros(0, np.int64)  # as when no visitor reaches a cell in which a vector lies
        i, j = (np.concatenate(side) for side in zip((none, none), *pairs))
        return np.stack([head, h1], axis=1), weight, i, j

    def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least = np.arange(n)
        while True:
            before = least.copy()
            low = np.minimum(least[i], least[j])
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
            least = least[least]
            if (least == before).all():
                return least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            kinds = block["kind"].to_numpy()
            if kinds.min() == kinds.max():
                continue
            classes, weight, i, j = found(block)
            if not len(i):
                continue
            nodes, at = np.unique(classes, axis=0, return_inverse=True)
            at = at.reshape(-1)
            i, j, w = at[i], at[j], np.zeros(len(nodes), np.int64)
            w[at] = weight
            count = np.bincount(i, w[j], len(nodes)) + np.bincount(j, w[i], len(nodes))
            least = spanning(len(nodes), i, j)
            some, moved = np.flatnonzero(count), np.flatnonzero(least != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([nodes[some, 0], nodes[moved, 0]])), pa.array(np.concatenate([nodes[some, 1], nodes[moved, 1]])),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[least[moved], 0])]),
                pa.array(np.concatenate([count[some].astype(np.int64), np.zeros(len(moved), np.int64)])),
            ], names=["x", "h1", "y", "n"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", recall: float | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Rows of the same label are linked if the cosine of their vectors is at
    least ``cosine``; all links are found, or with ``recall`` about that share
    of those at the threshold.  Rows whose label or id is null, or whose vector is null,
    empty, zero or holds null or non-finite components, are linked with nothing,
    as are vectors of different lengths.  Each row counts as a vector; rows that
    repeat an id share its component.  A row without an id has no component and
    is kept.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("linkable", F.col("vec").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(1), "label", "embedding"))
    rows = settle(rows, "vectors")
    good = rows.filter("linkable")
    classes = settle(good.groupBy("h1", "h2").agg(
        F.min("vec").alias("head"), F.count(F.lit(1)).alias("weight"),
        F.xxhash64(F.first("label"), F.size(F.first("embedding"))).alias("space"), F.first("embedding").alias("embedding")), "vector-classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not size.n:
        alone = F.lit(0).cast("long")
        return rows.select(F.col("vec").alias("vec_id"), alone.alias("n_links"), F.col("vec").alias("component_id"), F.lit(True).alias("kept"))
    drawn = classes.orderBy(F.xxhash64("head", "h1"), "head").limit(SAMPLE).select("embedding").toArrow()
    index = learn(unit(matrix(drawn["embedding"].combine_chunks(), size.width)), size.n, cosine, recall)

    kind = classes.schema["embedding"].dataType.simpleString()
    spread = settle(classes.select("head", "space", "weight", "embedding", "h1").mapInArrow(
        _visits(index), f"key long, kind int, code int, head long, space long, weight long, embedding {kind}, h1 long"), "vector-visits")
    counts = spread.groupBy("key").agg(F.sum(1 - F.col("kind")).alias("lying"), F.sum("kind").alias("visiting")).filter("lying > 0 and visiting > 1")
    cut = spread.join(counts, "key")
    cut = cut.withColumn("lying", F.ceil(F.col("lying") / PIECE).cast("int")).withColumn("visiting", F.ceil(F.col("visiting") / PIECE).cast("int"))
    place = F.xxhash64(F.lit(3), F.col("head"), F.col("h1"))
    cut = cut.withColumn("i", F.explode(F.when(F.col("kind") == 0, F.array(F.pmod(place, F.col("lying")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("lying") - 1))))
    cut = cut.withColumn("j", F.explode(F.when(F.col("kind") == 1, F.array(F.pmod(place, F.col("visiting")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("visiting") - 1))))
    block = ["key", "i", "j"]
    cut = cut.select(*block, "kind", "code", "head", "h1", "space", "weight", "embedding").repartition(*block).sortWithinPartitions(*block)
    result = settle(cut.mapInArrow(_compare(index, cosine), "x long, h1 long, y long, n long"), "vector-links")

    linked = result.filter("y is null").groupBy(F.col("x").alias("head"), "h1").agg(F.sum("n").alias("others"))
    placed = good.select("vec", "h1", "h2").join(classes.select("h1", "h2", "head"), ["h1", "h2"])
    several = placed.groupBy("vec").agg(F.min("head").alias("lo"), F.max("head").alias("hi")).filter("lo < hi").select("vec")
    tied = placed.join(several, "vec", "left_semi").select(F.col("vec").alias("x"), F.col("head").alias("y"))
    groups = components(result.filter("y is not null").select("x", "y").unionByName(tied), "x", "y").withColumnRenamed("node", "head")
    of_class = (
        classes.select("h1", "h2", "head", "weight").join(linked, ["head", "h1"], "left").join(groups, "head", "left")
        .select("h1", "h2", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "head").alias("component"), F.lit(True).alias("linkable"))
    )
    return rows.join(of_class, ["h1", "h2", "linkable"], "left").select(
        F.col("vec").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec").alias("component_id"),
        F.coalesce(F.col("vec") == F.coalesce("component", "vec"), F.lit(True)).alias("kept"))
