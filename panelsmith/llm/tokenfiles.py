"""Token ids of a corpus in compressed files that many tasks can read at once.

A folder holds two Parquet tables: ``frequencies``, one table of ids with
frequencies that all blocks share, and ``blocks``.  Documents are placed by
ranges of their id and written in ascending order, one shard a task.  A shard's
ids form one long run that is cut into blocks of ``rans.BLOCK`` ids, whatever
documents they belong to.  A block is coded by itself with a numeral system
(``rans``), has a checkpoint every ``rans.SEGMENT`` ids from which decoding can
begin, a checksum over all that decoding needs, and the list of the documents,
or parts of documents, that lie in it.

Spark's writer commits the files, so a task that is run twice leaves one copy,
and Spark's reader deals blocks to tasks as it likes: the checksum of a
document that several blocks share is put together from those of its parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelsmith.llm import rans
from panelsmith.llm.packing import tokenized, tokenizer_path, unpack_ids

END_ID = 2
COUNT_AT_ONCE = 1 << 20  # ids
DENSE_IDS = 1 << 22  # ids below this are counted in an array
BLOCKS_AT_ONCE = 8  # decoded together, which makes the arrays of a step longer


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dense, sparse, held = np.zeros(0, np.int64), {}, []

    def add() -> None:
        nonlocal dense
        ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
        held.clear()
        few = np.bincount(ids[ids < DENSE_IDS])
        if len(few) > len(dense):
            few[:len(dense)] += dense
            dense = few
        else:
            dense[:len(few)] += few
        for i, n in zip(*np.unique(ids[ids >= DENSE_IDS], return_counts=True)):
            sparse[int(i)] = sparse.get(int(i), 0) + int(n)

    size = 0
    for batch in batches:
        for packed in batch.column(0):
            held.append(unpack_ids(packed.as_py()))
            size += len(held[-1])
            if size >= COUNT_AT_ONCE:
                add()
                size = 0
    add()
    some = np.flatnonzero(dense)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*some.tolist(), *sparse], pa.int64()), pa.array([*dense[some].tolist(), *sparse.values()], pa.int64())], names=["id", "n"])


def shared_frequencies(tokens: DataFrame) -> rans.Frequencies:
    """Counts of all ids of the corpus, scaled.  As many rows as there are different ids come to the driver.

    The largest table of frequencies bounds them; one more is asked for, to notice that it is not enough.
    """
    most = 1 << (rans.MOST_SCALE - 4)
    counted = tokens.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = counted.limit(most + 1).toArrow().sort_by("id")
    return rans.frequencies(table["id"].to_numpy(), table["n"].to_numpy())


def checksum(n: int, words: bytes, starts: bytes, states: bytes) -> int:
    return zlib.crc32(states, zlib.crc32(starts, zlib.crc32(words, n)))


def _blocks(table: rans.Frequencies, kind: pa.DataType):
    def block(shard: int, number: int, ids: np.ndarray, parts: list[tuple]) -> pa.RecordBatch:
        words, starts, states = rans.encode(ids, table)
        packed = words.tobytes(), starts.astype("<i8").tobytes(), states.astype("<u8").tobytes()
        doc, at, length, total = zip(*parts)
        held = pa.StructArray.from_arrays(
            [pa.array(doc, kind), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64())],
            names=["doc", "at", "length", "total"])
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([number * rans.BLOCK], pa.int64()), pa.array([len(ids)], pa.int32()),
            pa.array([checksum(len(ids), *packed)], pa.int64()), *(pa.array([x], pa.binary()) for x in packed),
            pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), held),
        ], names=["shard", "first", "n", "crc32", "words", "checkpoints", "states", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        held, size, parts = [], 0, []
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = unpack_ids(packed.as_py())
                at = 0
                while at < len(ids):
                    some = ids[at:at + rans.BLOCK - size]
                    held.append(some)
                    parts.append((doc, at, len(some), len(ids)))
                    size += len(some)
                    at += len(some)
                    if size == rans.BLOCK:
                        yield block(shard, number, np.concatenate(held), parts)
                        number, held, size, parts = number + 1, [], 0, []
        if size:
            yield block(shard, number, np.concatenate(held), parts)

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode all texts by a tokenizer file and write their ids to ``folder`` in ascending order of the documents' ids.

    Every row is a document of its own and ends with ``end_id``; a null or
    empty text is that id alone.  Rows without an id come first; rows that
    repeat an id stay apart and follow each other.  Other columns are ignored.
    An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, path or tokenizer_path(), id_col, text_col, end_id)
    table = shared_frequencies(tokens)
    spark.createDataFrame(list(zip(table.ids.tolist(), table.freq.tolist())), "id long, freq long").coalesce(1).write.parquet(f"{folder}/frequencies")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = tokens.schema["doc"].dataType.simpleString()
    placed = tokens.repartitionByRange(shards, F.asc_nulls_first("doc"), "row").sortWithinPartitions(F.asc_nulls_first("doc"), "row")
    blocks = placed.select("doc", "ids").mapInArrow(
        _blocks(table, tokens.select("doc").limit(0).toArrow().schema.field(0).type),
        "shard int, first long, n int, crc32 long, words binary, checkpoints binary, states binary, "
        f"docs array<struct<doc: {kind}, at: bigint, length: bigint, total: bigint>>")
    blocks.write.option("compression", "zstd").parquet(f"{folder}/blocks")


def frequencies_of(spark: SparkSession, folder: str) -> rans.Frequencies:
    table = spark.read.parquet(f"{folder}/frequencies").toArrow().sort_by("id")
    freq = table["freq"].to_numpy().astype(np.uint64)
    return rans.Frequencies(table["id"].to_numpy().astype(np.uint32), freq, max(int(freq.sum()).bit_length() - 1, 0))


POLYNOMIAL = 0xEDB88320  # fixed value: the checksum's polynomial, lowest power in the highest bit


def _product(a: int, b: int) -> int:
    """Of two polynomials modulo that of the checksum."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


def shifted(crc: int, n_bytes: int) -> int:
    """What a part's checksum adds (by exclusive or) to that of the whole when ``n_bytes`` follow the part."""
    power, square = 0x80000000, 0x40000000  # 1 and x
    n = 8 * n_bytes
    while n:
        if n & 1:
            power = _product(power, square)
        square = _product(square, square)
        n >>= 1
    return _product(crc, power)


def _checked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if checksum(row["n"], row["words"], row["checkpoints"], row["states"]) != row["crc32"]:
        raise ValueError(f"block {row['first']} of shard {row['shard']} is damaged")
    return (np.frombuffer(row["words"], "<u4"), np.frombuffer(row["checkpoints"], "<i8"),
            np.frombuffer(row["states"], "<u8").reshape(-1, rans.LANES))


def _decoded(batch: pa.RecordBatch, table: rans.Frequencies) -> Iterator[tuple[int, dict, np.ndarray]]:
    """Each block of a batch with its ids; whole blocks that follow each other are decoded together."""
    k = 0
    while k < batch.num_rows:
        rows, held, words = [], [], 0
        while k < batch.num_rows and len(rows) < BLOCKS_AT_ONCE and (not rows or rows[-1]["n"] == rans.BLOCK):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "docs"}
            some, starts, states = _checked(row)
            held.append((some, starts + words, states))
            rows.append(row)
            words += len(some)
            k += 1
        ids = rans.decode(*map(np.concatenate, zip(*held)), sum(row["n"] for row in rows), table)
        for i, row in enumerate(rows):
            yield k - len(rows) + i, row, ids[i * rans.BLOCK:i * rans.BLOCK + row["n"]]


def _parts(table: rans.Frequencies, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row, ids in _decoded(batch, table):
                docs = batch.column("docs").slice(k, 1).flatten()
                at, length, total = (docs.field(c).to_numpy() for c in ("at", "length", "total"))
                ends = np.cumsum(length)
                own = [ids[e - n:e] for e, n in zip(ends, length)]
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
                for i in np.flatnonzero(at + length < total):
                    crcs[i] = shifted(crcs[i], int(4 * (total[i] - at[i] - length[i])))
                columns = [
                    pa.array(np.full(len(own), row["shard"], np.int32)), docs.field("doc"), pa.array(row["first"] + ends - length - at),
                    pa.array(at), pa.array(length), pa.array(crcs, pa.int64())]
                names = ["shard", "doc", "doc_start", "at", "length", "crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)
        pa.default_memory_pool().release_unused()

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document, decoded from the files: ``doc, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before it.  A block whose
    checksum does not fit is an error.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.select(F.explode("docs.doc").alias("doc")).schema["doc"].dataType.simpleString()
    parts = blocks.mapInArrow(
        _parts(frequencies_of(spark, folder), with_ids),
        f"shard int, doc {kind}, doc_start long, at long, length long, crc32 long" + ", ids array<long>" * with_ids)
    whole = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"])).alias("ids")] if with_ids else []
    docs = parts.groupBy("shard", "doc_start").agg(
        F.first("doc").alias("doc"), F.sum("length").alias("n_tokens"), F.expr("bit_xor(crc32)").alias("ids_crc32"), *whole)
    return docs.join(_shard_starts(blocks), "shard").select(
        "doc", (F.col("shard_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard; as many rows as shards were written."""
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("size"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long").alias("shard_start"))


def span(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """The ids from place ``start`` to before ``stop`` of the whole corpus, as rows ``(start, ids)``.

    Only blocks that reach into the span are read, and of them only the
    segments that do are decoded, each from its checkpoint.
    """
    table = frequencies_of(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    placed = blocks.join(_shard_starts(blocks), "shard").withColumn("place", F.col("shard_start") + F.col("first"))
    placed = placed.filter((F.col("place") < stop) & (F.col("place") + F.col("n") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, checkpoints, states = _checked(row)
                lo, hi = max(start - row["place"], 0), min(stop - row["place"], row["n"])
                a, b = lo // rans.SEGMENT, -(-hi // rans.SEGMENT)
                n = min(b * rans.SEGMENT, row["n"]) - a * rans.SEGMENT
                ids = rans.decode(words, checkpoints[a:b], states[a:b], n, table)[lo - a * rans.SEGMENT:hi - a * rans.SEGMENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["place"] + lo], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    return placed.drop("docs", "shard_start").mapInArrow(run, "start long, ids array<long>")
