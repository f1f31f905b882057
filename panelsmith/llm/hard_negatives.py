"""Hard negatives of anchors, with scores bounded by summaries of vector segments.

Vectors are turned to integers.  A vector is cut into segments, at several
levels, each level's inside those of the level above.  A segment's mean m and
deviation s are stored.  The inner product of two segments of length n lies
between n (m m' - s s') and n (m m' + s s'), so a level's summaries bound a
score from both sides in a fraction of the work of the score itself.

Rows that no bound rules out go on to the next level and last to exact scores:
a row is ruled out if it cannot reach the range of scores that is looked for,
or if enough rows are sure to be better.  No score is lost, whatever the
vectors are like; on vectors without structure the bounds rule out little.

First the positives of each anchor are found among the rows of its label, then
the negatives among all others.  Rows lie in pieces of bounded size; a task
holds one piece and lets the anchors stream past it, a chunk at a time.  It
returns at most as many rows for an anchor as are wanted in the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.blocks import blocks
from panelsmith.llm.embedding_dedup import matrix
from panelsmith.storage import settle

STEPS = 256  # of a unit
LEVELS = (1, 4, 16)  # segments at each level
LARGEST = 2.0**56  # squared length, beyond which scores times 100 might not fit
EXACT = 2.0**53  # whole numbers below this are exact as doubles
PIECE = 32_768  # rows that a task holds
AT_ONCE = 4096  # rows that a chunk of anchors is compared with at once
CHUNK = 64  # anchors
ANCHORS = 1 << 18  # that pass one piece in one task
SLACK = 1e-6  # root of the relative rounding error that is allowed for
DENSE = 0.1  # share of rows above which exact scores are computed for all


def edges(width: int, segments: int) -> np.ndarray:
    return np.arange(segments + 1) * width // segments


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all levels' segments, each times the root of the segment's length."""
    means, spreads = [], []
    for segments in LEVELS:
        cut = edges(q.shape[1], segments)
        for lo, hi in zip(cut, cut[1:]):
            part = q[:, lo:hi].astype(float)
            mean = part.mean(axis=1) if hi > lo else np.zeros(len(q))
            means.append(mean * np.sqrt(hi - lo))
            spreads.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(spreads, axis=1)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        widths = np.diff(batch.column(2).offsets.to_numpy())
        for width in np.unique(widths):
            part = batch.take(pa.array(np.flatnonzero(widths == width)))
            q = np.floor(STEPS * matrix(part.column(2), width)) if width else np.zeros((part.num_rows, 0))
            size = (q * q).sum(axis=1)
            part, q, size = part.filter(pa.array(size < LARGEST)), q[size < LARGEST], size[size < LARGEST]
            n = len(q)
            means, spreads = summaries(q)
            lists = [(q.astype(np.int64), pa.int64()), (means, pa.float64()), (spreads, pa.float64())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), part.column(0), part.column(1), pa.array(np.full(n, width), pa.int32()), pa.array(np.sqrt(size)),
                *(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind)) for x, kind in lists),
            ], names=["row", "id", "label", "width", "size", "q", "means", "spreads"])
            row += n


def summarised(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """The rows that take part, as integers and with the summaries of their segments, written once."""
    x = F.col(vector_col)
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    part = rows.filter(finite & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    part = part.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("label"), x.alias("x"))
    return settle(part.mapInArrow(
        _summarised, "row long, id long, label long, width int, size double, q array<long>, means array<double>, spreads array<double>"), "segments")


class Rows:
    """Some rows' ids, labels, integers and summaries as arrays."""

    def __init__(self, table: pa.Table):
        column = lambda name: table[name].combine_chunks()
        n, width = table.num_rows, int(table["width"][0].as_py())
        self.row, self.id, self.label = (table[c].to_numpy() for c in ("row", "id", "label"))
        self.size = table["size"].to_numpy()
        self.q = column("q").flatten().to_numpy().reshape(n, width)
        self.exact = self.q.astype(float)
        self.means, self.spreads = (column(c).flatten().to_numpy().reshape(n, sum(LEVELS)) for c in ("means", "spreads"))

    def __len__(self) -> int:
        return len(self.id)


def _scores(a: Rows, i, b: Rows, j) -> np.ndarray:
    """Exact inner products of anchors ``i`` and rows ``j``."""
    if a.size.max() * b.size.max() < EXACT:
        return (a.exact[i] @ b.exact[j].T).astype(np.int64)
    return a.q[i] @ b.q[j].T


def best(a: Rows, b: Rows, allowed: np.ndarray, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int,
         found: list[list[tuple[int, int]]]) -> int:
    """Add to ``found``, by window, the best ``k`` rows of ``b`` as (-score, id) and keep the best.

    Window w looks for scores from ``lo[w]`` to ``hi[w]`` for anchor ``owner[w]``.
    Returns for how many pairs the exact score was needed.
    """
    floor = np.array([max(low, -f[k - 1][0]) if len(f) >= k else low for low, f in zip(lo, found)])
    lowest, highest = np.full(len(a), np.inf), np.full(len(a), -np.inf)
    np.minimum.at(lowest, owner, floor)
    np.maximum.at(highest, owner, hi)
    live, mask, at = np.arange(len(b)), allowed, 0
    for segments in LEVELS:
        own = slice(at, at + segments)
        at += segments
        middle = a.means[:, own] @ b.means[live, own].T
        reach = a.spreads[:, own] @ b.spreads[live, own].T + np.outer(SLACK * a.size, SLACK * b.size[live]) + 0.5
        upper, lower = middle + reach, middle - reach
        mask = mask & (upper >= lowest[:, None]) & (lower <= highest[:, None])
        some = mask.any(axis=0)
        if not some.any():
            return 0
        live, mask, upper, lower = live[some], mask[:, some], upper[:, some], lower[:, some]
    chosen = []
    for w, i in enumerate(owner):
        at = np.flatnonzero(mask[i] & (upper[i] >= floor[w]) & (lower[i] <= hi[w]))
        sure = at[(lower[i, at] >= floor[w]) & (upper[i, at] <= hi[w])]
        if len(sure) >= k:
            at = at[upper[i, at] >= np.partition(lower[i, sure], -k)[-k]]
        chosen.append(at)
    pairs = sum(map(len, chosen))
    every = _scores(a, slice(None), b, live) if pairs > DENSE * len(owner) * len(b) else None
    for w, (i, at) in enumerate(zip(owner, chosen)):
        if not len(at):
            continue
        score = every[i, at] if every is not None else _scores(a, slice(i, i + 1), b, live[at])[0]
        inside = (score >= floor[w]) & (score <= hi[w])
        score, ids = score[inside], b.id[live[at[inside]]]
        if len(score) > k:
            top = score >= np.partition(score, -k)[-k]
            score, ids = score[top], ids[top]
            first = np.lexsort((ids, -score))[:k]
            score, ids = score[first], ids[first]
        if len(score):
            found[w] = sorted(found[w] + list(zip((-score).tolist(), ids.tolist())))[:k]
    return pairs


def _searched(same_label: bool, k: int):
    keys = ("group", "width", "piece", "part", "side", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None
        for block in blocks(batches, keys):
            key = tuple(block[c][0].as_py() for c in keys[:4])
            if block["side"][0].as_py() == 0:
                held, held_key = [Rows(block.slice(lo, AT_ONCE)) for lo in range(0, block.num_rows, AT_ONCE)], key
                continue
            if key != held_key:
                continue
            for start in range(0, block.num_rows, CHUNK):
                part = block.slice(start, CHUNK)
                a = Rows(part)
                ends = part["lo"].combine_chunks().offsets.to_numpy()
                owner = np.repeat(np.arange(len(a)), np.diff(ends))
                lo, hi = (part[c].combine_chunks().flatten().to_numpy().astype(float) for c in ("lo", "hi"))
                found: list[list[tuple[int, int]]] = [[] for _ in owner]
                for b in held:
                    allowed = ((a.label[:, None] == b.label) == same_label) & (a.id[:, None] != b.id)
                    best(a, b, allowed, owner, lo, hi, k, found)
                place = np.arange(len(owner)) - (ends - ends[0])[:-1][owner]
                rows = [(a.row[owner[w]], place[w], i, -s) for w, f in enumerate(found) for s, i in f]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["anchor", "window", "id", "score"])

    return run


def search(rows: DataFrame, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """``(anchor, window, id, score, rank)``: the best ``k`` rows for each window of each anchor.

    ``anchors`` are rows of ``rows`` with arrays ``lo`` and ``hi``, one window each.
    """
    group = F.col("label") if same_label else F.lit(0).cast("long")
    near, far = rows.withColumn("group", group), anchors.withColumn("group", group)
    sizes = near.groupBy("group", "width").agg(F.count(F.lit(1)).alias("n"))
    asked = far.groupBy("group", "width").agg(F.count(F.lit(1)).alias("m"))
    sizes = settle(sizes.join(asked, ["group", "width"]).select(
        "group", "width", F.expr(f"cast((n - 1) div {PIECE} + 1 as int)").alias("pieces"), F.expr(f"cast((m - 1) div {ANCHORS} + 1 as int)").alias("parts")), "search-sizes")
    spread = F.xxhash64("row")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = (
        near.join(sizes, ["group", "width"]).withColumn("piece", F.pmod(spread, F.col("pieces")).cast("int")).withColumn("part", every("parts"))
        .withColumn("side", F.lit(0)).withColumn("chunk", F.lit(0))
        .withColumn("lo", F.lit(None).cast("array<long>")).withColumn("hi", F.lit(None).cast("array<long>"))
    )
    far = (
        far.join(sizes, ["group", "width"]).withColumn("part", F.pmod(spread, F.col("parts")).cast("int")).withColumn("piece", every("pieces"))
        .withColumn("side", F.lit(1)).withColumn("chunk", F.pmod(F.shiftright(spread, 16), F.lit(max(1, ANCHORS // 1024))).cast("int"))
    )
    columns = ["group", "width", "piece", "part", "side", "chunk", "row", "id", "label", "size", "q", "means", "spreads", "lo", "hi"]
    met = near.select(*columns).unionByName(far.select(*columns))
    met = met.repartition("group", "width", "piece", "part").sortWithinPartitions("group", "width", "piece", "part", "side", "chunk")
    hits = met.mapInArrow(_searched(same_label, k), "anchor long, window long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Callable[[Column], Column], id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` makes of the id column the condition for anchors.  A vector's component
    x counts as floor(256 x), a score is the inner product.  The positives of an
    anchor are the ``positives`` best other rows of its label, and a pair's
    negatives the ``negatives`` best rows of other labels whose score is from
    ``low`` to ``high`` hundredths of the positive's, in order, ties by the
    smaller id.

    Rows whose id, label or vector is null, that hold a null or non-finite
    component, or whose squared length is 2**56 or more (components of hundreds
    of thousands) take no part.  Vectors of different length never meet; those
    without a component score 0.  Rows that repeat an id are rows of their own,
    but never each other's positive or negative.  An anchor without positives,
    and a pair without negatives, gives no row, as does an empty table.
    """
    stored = summarised(rows, id_col, label_col, vector_col)
    anchors = stored.filter(anchor(F.col("id")))
    every = F.array(F.lit(-(2**62)))
    pairs = settle(search(stored, anchors.withColumn("lo", every).withColumn("hi", F.array(F.lit(2**62))), True, positives), "positives")
    windows = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("held"))
    lo = F.expr(f"transform(held, p -> p.score * {low} div 100 + if(p.score * {low} % 100 > 0, 1, 0))")
    hi = F.expr(f"transform(held, p -> p.score * {high} div 100 - if(p.score * {high} % 100 < 0, 1, 0))")
    asked = stored.join(windows.select(F.col("anchor").alias("row"), lo.alias("lo"), hi.alias("hi")), "row")
    hits = search(stored, asked, False, negatives)
    named = pairs.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return hits.join(named, ["anchor", "window"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
