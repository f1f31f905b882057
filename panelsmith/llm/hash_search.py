"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred and rotated so that the signs of their principal directions
lose as little as possible (iterative quantisation on a bounded sample); the
signs are a code of up to 64 bits.  Codes are cut into substrings, each indexed
by its value.  Two codes within a Hamming radius R agree in some one of m
substrings up to R // m bits, so visiting the buckets that near in every
substring retrieves every code within R.  What is retrieved is ranked by the
Euclidean distance of the original vectors in double precision.

R is learned: for a bounded number of queries the true neighbours among *all*
rows are found, and R covers the wanted share of their codes' distances.
Queries that retrieve fewer than k rows within R are run again without a limit.

Buckets are brought together by the leading bits of their value and cut into
pieces of bounded size, as are the queries that visit them; a task returns at
most k rows for each query it sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.blocks import blocks
from panelsmith.llm.embedding_dedup import matrix, usable
from panelsmith.storage import settle

K = 10
BITS, SUBSTRINGS = 64, 4
SAMPLE = 8192  # most vectors that the rotation is learned from
RADIUS_QUERIES = 64  # queries whose true neighbours the radius is learned from
RECALL = 0.99  # share of true neighbours that the radius covers
PIECE, QUERY_PIECE = 4096, 1024
ROUNDS = 30


@dataclass(frozen=True)
class Hashing:
    width: int
    mean: np.ndarray
    rotation: np.ndarray  # (width, bits)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    @property
    def substrings(self) -> list[tuple[int, int]]:
        """First bit and number of bits of each substring."""
        m = min(SUBSTRINGS, self.bits)
        edges = [self.bits * i // m for i in range(m + 1)]
        return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = ((x - self.mean) @ self.rotation > 0).astype(np.uint64)
        return (signs << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def substring(self, codes: np.ndarray, s: int) -> np.ndarray:
        first, size = self.substrings[s]
        return (codes >> np.uint64(first)) & np.uint64((1 << size) - 1)


def learn(sample: np.ndarray) -> Hashing:
    """Centre, principal directions, and the rotation that brings them closest to their signs."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(BITS, sample.shape[1])
    _, directions = np.linalg.eigh(centred.T @ centred)
    directions = directions[:, ::-1][:, :bits]
    v = centred @ directions
    rotation, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(bits, bits)))
    for _ in range(ROUNDS):
        signs = np.where(v @ rotation > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(v.T @ signs)
        rotation = u @ w
    return Hashing(sample.shape[1], mean, directions @ rotation)


def distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows; squares are added one after another, so the last bit does not depend on how many rows there are."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += (q[:, k] - x[:, k]) ** 2
    return np.sqrt(total)


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, allowed: np.ndarray, k: int):
    """For each query the k nearest allowed rows, ties to smaller ids: (query row, row, distance)."""
    rough = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T
    rough = np.where(allowed, np.nan_to_num(rough, nan=np.inf), np.inf)
    slack = 1e-9 * ((q * q).sum(axis=1) + (x * x).sum(axis=1).max(initial=0))
    if rough.shape[1] > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
        near = allowed & (rough <= limit[:, None])
    else:
        near = allowed
    i, j = np.nonzero(near)
    d = distance(q[i], x[j])
    order = np.lexsort((x_ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], d[place < k]


def _true_neighbours(queries: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PIECE):
                batch = whole.slice(lo, PIECE)
                x, x_ids = matrix(batch.column(1), width), batch.column(0).to_numpy()
                same = np.diff(batch.column(1).offsets.to_numpy())[None, :] == sizes[:, None]
                i, j, d = nearest(queries, ids, x, x_ids, same & (ids[:, None] != x_ids[None]), k)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), batch.column(0).take(pa.array(j)), pa.array(d), batch.column(1).take(pa.array(j))],
                                                 names=["query", "vec", "distance", "embedding"])

    return run


def learned_radius(hashing: Hashing, queries: DataFrame, rows: DataFrame, k: int, recall: float = RECALL) -> int:
    """The Hamming radius that holds the given share of the true neighbours of a bounded number of queries."""
    some = queries.orderBy(F.xxhash64("vec"), "vec").limit(RADIUS_QUERIES).toArrow()
    if not some.num_rows:
        return hashing.bits
    column = some["embedding"].combine_chunks()
    q, ids = matrix(column, hashing.width), some["vec"].to_numpy()
    kind = rows.schema["embedding"].dataType.simpleString()
    near = rows.select("vec", "embedding").mapInArrow(
        _true_neighbours(q, ids, np.diff(column.offsets.to_numpy()), hashing.width, k), f"query int, vec long, distance double, embedding {kind}")
    best = Window.partitionBy("query").orderBy("distance", "vec")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).toArrow()
    if not near.num_rows:
        return hashing.bits
    apart = np.bitwise_count(hashing.codes(q)[near["query"].to_numpy()] ^ hashing.codes(matrix(near["embedding"].combine_chunks(), hashing.width)))
    return int(np.quantile(apart, recall, method="higher"))


def _bucket(prefix_bits: int, first: int, size: int) -> tuple[int, int]:
    lead = min(prefix_bits, size)
    return lead, size - lead


def _placed(hashing: Hashing, prefix_bits: int, reach: int, query: bool):
    """A row for each substring (indexed rows), or for each bucket prefix within reach (queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256 if query else 4096):
                batch = whole.slice(lo, 256 if query else 4096)
                codes = hashing.codes(matrix(batch.column(1), hashing.width))
                rows, subs, prefixes = [], [], []
                for s, (first, size) in enumerate(hashing.substrings):
                    lead, rest = _bucket(prefix_bits, first, size)
                    own = hashing.substring(codes, s) >> np.uint64(rest)
                    if query:
                        every = np.arange(1 << lead, dtype=np.uint64)
                        row, prefix = np.nonzero(np.bitwise_count(own[:, None] ^ every[None]) <= reach)
                    else:
                        row, prefix = np.arange(len(own)), own
                    rows.append(row)
                    prefixes.append(prefix.astype(np.int64))
                    subs.append(np.full(len(row), s, np.int32))
                taken = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(subs)), pa.array(np.concatenate(prefixes)), *taken.columns],
                                                 names=["sub", "prefix", "vec", "embedding"])

    return run


def _retrieve(hashing: Hashing, radius: int, k: int):
    """The k nearest of the codes within the radius that a block's queries meet there first."""
    reach = radius // len(hashing.substrings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ("sub", "prefix", "i", "j")):
            asks = block["asks"].to_numpy()
            asking, lying = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
            if not len(asking) or not len(lying):
                continue
            column = block["embedding"].combine_chunks()
            x, ids, sizes = matrix(column, hashing.width), block["vec"].to_numpy(), np.diff(column.offsets.to_numpy())
            codes, s = hashing.codes(x), block["sub"][0].as_py()
            q, c = codes[asking][:, None], codes[lying][None, :]

            values, bucket = np.unique(hashing.substring(codes[lying], s), return_inverse=True)
            probed = np.bitwise_count(hashing.substring(codes[asking], s)[:, None] ^ values[None, :]) <= reach
            met = probed[:, bucket]
            for before in range(s):  # met in an earlier substring already
                met &= np.bitwise_count(hashing.substring(q, before) ^ hashing.substring(c, before)) > reach
            met &= np.bitwise_count(q ^ c) <= radius
            met &= (ids[asking][:, None] != ids[lying][None, :]) & (sizes[asking][:, None] == sizes[lying][None, :])
            i, j, d = nearest(x[asking], ids[asking], x[lying], ids[lying], met, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[asking][i]), pa.array(ids[lying][j]), pa.array(d)], names=["query", "vec", "distance"])

    return run


def within_radius(hashing: Hashing, queries: DataFrame, rows: DataFrame, n_rows: int, radius: int, k: int) -> DataFrame:
    """``(query, vec, distance, rank)`` of the k nearest rows with a code within the radius."""
    reach = radius // len(hashing.substrings)
    prefix_bits = int(np.clip(np.ceil(np.log2(max(1, n_rows) / PIECE)), 0, 16))
    kind = rows.schema["embedding"].dataType.simpleString()
    schema = f"sub int, prefix long, vec long, embedding {kind}"
    indexed = rows.select("vec", "embedding").mapInArrow(_placed(hashing, prefix_bits, reach, False), schema).withColumn("asks", F.lit(0))
    asked = queries.select("vec", "embedding").mapInArrow(_placed(hashing, prefix_bits, reach, True), schema).withColumn("asks", F.lit(1))
    return _best(settle(indexed.unionByName(asked), "hash-buckets"), _retrieve(hashing, radius, k), k)


def scan(queries: DataFrame, rows: DataFrame, width: int, k: int) -> DataFrame:
    """The same of all rows, compared exactly, piece by piece: for queries that find too few within the radius."""
    one = [F.lit(0).alias("sub"), F.lit(0).cast("long").alias("prefix"), "vec", "embedding"]
    both = rows.select(*one, F.lit(0).alias("asks")).unionByName(queries.select(*one, F.lit(1).alias("asks")))
    return _best(both, _compared(width, k), k)


def _compared(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ("sub", "prefix", "i", "j")):
            asks = block["asks"].to_numpy()
            column = block["embedding"].combine_chunks()
            x, ids, sizes = matrix(column, width), block["vec"].to_numpy(), np.diff(column.offsets.to_numpy())
            for lo in range(0, int(asks.sum()), 64):
                asking, lying = np.flatnonzero(asks == 1)[lo:lo + 64], np.flatnonzero(asks == 0)
                met = (ids[asking][:, None] != ids[lying][None, :]) & (sizes[asking][:, None] == sizes[lying][None, :])
                i, j, d = nearest(x[asking], ids[asking], x[lying], ids[lying], met, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[asking][i]), pa.array(ids[lying][j]), pa.array(d)], names=["query", "vec", "distance"])

    return run


def _best(both: DataFrame, compare, k: int) -> DataFrame:
    """The k nearest of what ``compare`` finds in each bucket, cut into pieces where many rows or queries meet."""
    sizes = both.groupBy("sub", "prefix").agg(F.sum(1 - F.col("asks")).alias("lying"), F.sum("asks").alias("asking")).filter("lying > 0 and asking > 0")
    cut = both.join(sizes, ["sub", "prefix"])
    cut = cut.withColumn("lying", F.ceil(F.col("lying") / PIECE).cast("int")).withColumn("asking", F.ceil(F.col("asking") / QUERY_PIECE).cast("int"))
    place = F.xxhash64(F.lit(3), F.col("vec"))

    def piece(own: int, count: str):
        return F.explode(F.when(F.col("asks") == own, F.array(F.pmod(place, F.col(count)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(count) - 1)))

    block = ["sub", "prefix", "i", "j"]
    cut = cut.withColumn("i", piece(0, "lying")).withColumn("j", piece(1, "asking")).select(*block, "asks", "vec", "embedding")
    found = cut.repartition(*block).sortWithinPartitions(*block).mapInArrow(compare, "query long, vec long, distance double")
    best = Window.partitionBy("query").orderBy("distance", "vec")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its k nearest other rows, all if there are fewer.

    ``is_query`` is a condition on the rows.  Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without an id, take no part;
    vectors of different lengths are no neighbours.  A row with the query's id
    is no candidate.  Rows that repeat an id are candidates each; as queries
    they are one, with the vector of the smallest hash.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("embedding"), is_query.alias("asks"))
    rows = settle(rows.filter(F.col("vec").isNotNull() & usable(F.col("embedding"))), "search-rows")
    queries = settle(rows.filter("asks").groupBy("vec").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding")), "search-queries")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not size.n:
        return rows.sparkSession.createDataFrame([], empty)
    drawn = rows.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("embedding").toArrow()
    hashing = learn(matrix(drawn["embedding"].combine_chunks(), size.width))
    radius = learned_radius(hashing, queries, rows, k)
    found = settle(within_radius(hashing, queries, rows, size.n, radius, k), "search-found")
    enough = found.groupBy(F.col("query").alias("vec")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    few = settle(queries.join(enough, "vec", "left_anti"), "search-few")
    if radius < hashing.bits and not few.isEmpty():
        rest = scan(few, rows, size.width, k)
        found = found.join(few.select(F.col("vec").alias("query")), "query", "left_anti").unionByName(rest)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), F.col("distance").alias("score"))
