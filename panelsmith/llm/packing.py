"""Packing documents into sequences of a fixed number of tokens.

A document longer than the window gives whole windows; what is left of each
document is a piece shorter than the window.  The pieces' lengths make a
histogram of fewer bins than the window has tokens, whatever the corpus holds.
Combinations of two to four lengths that fill a window exactly are enumerated,
and non-negative least squares finds how often to repeat each so that together
they use up the histogram.  The counts are rounded down to what the histogram
really holds.  Pieces are dealt to the places of the combinations by their rank
within their length; those left over are laid end to end, greedily, and cut
where a window is full, so only the very last sequence has room left.

Only the histogram (at most window - 1 rows) comes to the driver, and only the
plan made of it (at most ``MOST_COMBINATIONS`` combinations) goes out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelsmith.llm.tokenizing import word_tokenizer
from panelsmith.storage import settle

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
FREQUENT = {3: 48, 4: 14}  # so many of the commonest lengths start combinations of three and four
MOST_COMBINATIONS = 4096
SWEEPS = 200
ROWS_PER_STRETCH = 1_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo in range(0, batch.num_rows, 256):
                some = min(256, batch.num_rows - lo)
                ids = [np.append(tokenizer.encode(texts[i].as_py()), np.uint32(end_id)) for i in range(lo, lo + some)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + some)), batch.column(0).slice(lo, some),
                    pa.array([len(x) for x in ids], pa.int64()), pa.array([pack_ids(x) for x in ids], pa.binary()),
                ], names=["row", "doc", "n", "ids"])
                row += some
        pa.default_memory_pool().release_unused()

    return run


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as bytes: two each if all fit, else four; the first byte tells which."""
    if not len(ids) or ids.max() < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype("<u4")


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(row, doc, n, ids)``: each row's ids with the end id, written once; a null text has the end id only."""
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return settle(pairs.mapInArrow(_tokens(path, end_id), f"row long, doc {kind}, n long, ids binary"), "tokens", "zstd")


@dataclass(frozen=True)
class Plan:
    """Combinations of lengths with how often each is repeated."""

    window: int
    combinations: list[tuple[tuple[int, ...], int]]
    left_over: int  # tokens that no combination takes

    @property
    def combined(self) -> int:
        return sum(n for _, n in self.combinations)

    def places(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, rank after the last, first sequence, offset) for each place of each combination."""
        next_rank: dict[int, int] = {}
        out, sequence = [], 0
        for lengths, n in self.combinations:
            offset = 0
            for length in lengths:
                first = next_rank.get(length, 0)
                out.append((length, first, first + n, sequence, offset))
                next_rank[length] = first + n
                offset += length
            sequence += n
        return out


def fillings(histogram: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Two lengths, or three or four that start with common ones, which fill the window exactly."""
    common = sorted(histogram, key=lambda length: (-histogram[length], length))
    found = {(a, window - a) for a in histogram if 2 * a <= window and window - a in histogram}
    for depth, most in FREQUENT.items():
        for start in combinations_with_replacement(sorted(common[:most]), depth - 1):
            rest = window - sum(start)
            if rest in histogram:
                found.add(tuple(sorted((*start, rest))))
    ordered = sorted(found, key=lambda c: (len(c), -min(histogram[x] for x in c), c))
    return ordered[:MOST_COMBINATIONS]


def repeat_counts(columns: list[tuple[int, ...]], histogram: dict[int, int]) -> list[float]:
    """Non-negative least squares: how often to repeat each combination, by descent along one count at a time."""
    uses = [{x: c.count(x) for x in set(c)} for c in columns]
    norms = [sum(n * n for n in u.values()) for u in uses]
    left = {x: float(n) for x, n in histogram.items()}
    counts = [0.0] * len(columns)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, use in enumerate(uses):
            step = sum(n * left[x] for x, n in use.items()) / norms[j]
            step = max(step, -counts[j])
            if step:
                counts[j] += step
                for x, n in use.items():
                    left[x] -= n * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return counts


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    columns = fillings(histogram, window)
    counts = repeat_counts(columns, histogram)
    left = dict(histogram)
    chosen = []
    for j in sorted(range(len(columns)), key=lambda j: (-counts[j], columns[j])):
        use = {x: columns[j].count(x) for x in set(columns[j])}
        n = min(int(counts[j] + 1e-9), *(left[x] // k for x, k in use.items()))
        if n > 0:
            chosen.append((columns[j], n))
            for x, k in use.items():
                left[x] -= k * n
    return Plan(window, chosen, sum(x * n for x, n in left.items()))


def _before(column: str, stretch: list[str], order: list[str], rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``column`` over all earlier rows of the same ``stretch[:-1]``.

    The last of ``stretch`` cuts each group so that no task sums up a whole
    one: sums within the cuts first, then those of the cuts before.
    """
    sums = rows.groupBy(*stretch).agg(F.sum(column).alias("held"))
    earlier = Window.partitionBy(*(stretch[:-1] or [F.lit(0)])).orderBy(stretch[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*stretch, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum(column).over(inside), F.lit(0)))
        .join(starts, stretch).withColumn(name, (F.col("start") + F.col("inside")).cast("long")).drop("start", "inside")
    )


def placed(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, pieces)``: where each stretch of a row's ids goes, as structs (start, length, sequence_id, offset)."""
    spark: SparkSession = tokens.sparkSession
    sizes = tokens.select("row", "n", F.expr(f"n div {window}").alias("full"), (F.col("n") % window).cast("int").alias("rest"))
    bins = sizes.groupBy("rest").agg(F.count(F.lit(1)).alias("pieces")).collect()  # at most `window` rows
    histogram = {b.rest: b.pieces for b in bins if b.rest}
    stretches = max(1, -(-sum(b.pieces for b in bins) // ROWS_PER_STRETCH)) * 8
    made = plan(histogram, window)
    sizes = sizes.withColumn("stretch", F.pmod(F.xxhash64("row"), F.lit(stretches)).cast("int")).withColumn("one", F.lit(1))

    ranked = _before("one", ["rest", "stretch"], ["row"], sizes.filter("rest > 0"), "rank")
    places = spark.createDataFrame(made.places(), "rest int, lo long, hi long, first long, place int")
    inside = [ranked["rest"] == places["rest"], F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")]
    ranked = settle(ranked.join(F.broadcast(places), inside, "left").select(  # at most 4 MOST_COMBINATIONS rows
        ranked["row"], ranked["rest"], "full", "stretch", "place", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence"),
    ), "pack-ranks")

    start = F.col("full") * window
    combined = ranked.filter("sequence is not null").select("row", F.array(F.struct(
        start.alias("start"), F.col("rest").cast("long").alias("length"), F.col("sequence").alias("sequence_id"),
        F.col("place").cast("long").alias("offset"))).alias("tail"))
    loose = _before("rest", ["stretch"], ["row"], ranked.filter("sequence is null").select("row", "full", "rest", "stretch"), "at")
    first_loose = made.combined
    offset = F.col("at") % window
    head = F.least(F.col("rest").cast("long"), window - offset)
    sequence = F.expr(f"at div {window}") + first_loose
    cut = F.array(
        F.struct(start.alias("start"), head.alias("length"), sequence.alias("sequence_id"), offset.alias("offset")),
        F.struct((start + head).alias("start"), (F.col("rest") - head).alias("length"), (sequence + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    )
    loose = loose.select("row", F.filter(cut, lambda p: p["length"] > 0).alias("tail"))
    tails = combined.unionByName(loose)

    first_full = first_loose + -(-made.left_over // window)
    filled = _before("full", ["stretch"], ["row"], sizes.filter("full > 0").select("row", "full", "stretch"), "at")
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda i: F.struct(
        (i * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("at") + first_full + i).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset")))
    filled = filled.select("row", whole.alias("whole"))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    return filled.join(tails, "row", "full_outer").select(
        "row", F.concat(F.coalesce("whole", none), F.coalesce("tail", none)).alias("pieces"))


def _cut(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                which, crcs, kept = [], [], []
                pieces = part.column(2)
                bounds = pieces.offsets.to_numpy()
                flat = pieces.values.slice(bounds[0], bounds[-1] - bounds[0])
                starts, lengths = flat.field("start").to_numpy(), flat.field("length").to_numpy()
                bounds = bounds - bounds[0]
                for i in range(part.num_rows):
                    ids = unpack_ids(part.column(1)[i].as_py())
                    for k in range(bounds[i], bounds[i + 1]):
                        own = ids[starts[k]:starts[k] + lengths[k]]
                        which.append(i)
                        crcs.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            kept.append(own.astype(np.int32))
                columns = [
                    part.column(0).take(pa.array(which, pa.int32())), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64()),
                    part.column(3).take(pa.array(which, pa.int32())), flat.field("sequence_id"), flat.field("offset"),
                ]
                names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    Every row of ``docs`` is a document of its own, whether or not its id is
    null or repeated; a null or empty text is the end id alone.  Sequences are
    filled without gaps from offset 0.  An empty table gives an empty one.
    """
    tokens = tokenized(docs, path or tokenizer_path(), id_col, text_col, end_id)
    kind = tokens.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    joined = tokens.join(placed(tokens, window), "row").select("doc", "ids", "pieces", "n")
    return joined.mapInArrow(_cut(with_ids), schema + ", ids array<int>" * with_ids)
