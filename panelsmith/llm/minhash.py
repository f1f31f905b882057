"""Near copies of documents by b-bit MinHash.

1. Every document's set of word shingles gives 96 minima.  Three minima at a
   time make one of 32 band keys; the low four bits of all minima are packed
   into six longs.
2. Documents with the same set form a class; its smallest id stands for it
   from here on, so thousands of copies are one row.
3. In each band bucket, all are paired with one pivot, the member that shares
   most buckets with others.  A pair goes on if its packed signatures agree in
   so many places that, corrected for chance agreement, the similarity can
   reach the threshold.  What goes on is confirmed on the full sets.
4. Buckets whose members are in one group by now are done.  In the others
   members of different groups are compared by their signatures, in blocks of
   bounded size that return members and not pairs; blocks of those within reach
   are compared on full sets and return only links that join groups.  So every
   pair that shares a bucket is confirmed, connected already, or out of reach.

A pair of similarity 0.85 shares no bucket with probability (1 - 0.85^3)^32,
about 6e-14 (0.8: 1e-10), and the signature test loses it with about 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.blocks import blocks
from panelsmith.llm.components import components
from panelsmith.llm.textbytes import mix, shingles, slices
from panelsmith.storage import settle

ROWS, BANDS, LOW_BITS = 3, 32, 4
HASHES = ROWS * BANDS
PER_LONG = 64 // LOW_BITS
SIGNATURE_LONGS = HASHES // PER_LONG
DEVIATIONS = 5.0  # standard deviations that an estimate may fall below the threshold
BLOCK, BLOCK_SHINGLES = 512, 1_000_000  # members of a bucket, and their shingles, that are compared with as many at once

_DIGEST = "doc long, n_shingles long, f1 long, f2 long, bands array<long>, signature array<long>"


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(short), 2048):
        np.minimum(out, (short[lo:lo + 2048, None] * a + b).min(axis=0), out=out)
    return out


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        band_salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))
        nibbles = (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(LOW_BITS))[None, :]
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1)):
                n = len(part)
                sizes, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                lows = np.zeros((n, HASHES), np.uint32)
                for i, found in enumerate(shingles(part.words(), width)):
                    sizes[i] = len(found)
                    if len(found):
                        f1[i] = mix(found).sum(dtype=np.uint64)
                        f2[i] = np.bitwise_xor.reduce(mix(found + np.uint64(0x5851F42D4C957F2D)))
                        lows[i] = minima(found, a, b)
                key = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(31) + lows[:, r::ROWS].astype(np.uint64) + band_salt)
                low = (lows & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint64).reshape(n, SIGNATURE_LONGS, PER_LONG)
                packed = (low << nibbles).sum(axis=2, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(part.first, n).cast(pa.int64()), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    _rows(key), _rows(packed),
                ], names=["doc", "n_shingles", "f1", "f2", "bands", "signature"])

    return run


def _rows(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.reshape(-1).view(np.int64)))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = list(shingles(part.words(), width))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, len(part)).cast(pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64))),
                ], names=["doc", "shingles"])

    return run


def agreements(x: Column, y: Column) -> Column:
    """In how many places two packed signatures hold the same low bits, by counting bits."""
    ones = sum(1 << (LOW_BITS * i) for i in range(PER_LONG))
    ones = ones - (1 << 64) if ones >> 63 else ones

    def differing(i: int) -> Column:
        z = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        folded = z
        for k in range(1, LOW_BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    total = differing(0)
    for i in range(1, SIGNATURE_LONGS):
        total = total + differing(i)
    return F.lit(HASHES) - total


def estimate(agreeing: Column) -> Column:
    """Similarity from the share of agreeing places, without those that agree by chance."""
    chance = 2.0**-LOW_BITS
    return (agreeing / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def least_agreements(similarity: float) -> int:
    """Places that must agree for a pair to go on: the expected number less some standard deviations."""
    chance = 2.0**-LOW_BITS
    p = chance + (1 - chance) * similarity
    return int(np.floor(HASHES * p - DEVIATIONS * np.sqrt(HASHES * p * (1 - p))))


def _longs(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, width)


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare with rows: all with all in a piece of its own, else the first piece with the second."""
    own = block["own"].to_numpy()
    return (np.flatnonzero(own == 0),) * 2 if (own == 0).all() else (np.flatnonzero(own == 1), np.flatnonzero(own == 2))


def _within_reach(least: int):
    """Members that may be linked to a member of another group: one row each, not one for each pair.

    A pair counts in the first bucket it shares only.
    """
    ones = np.uint64(sum(1 << (LOW_BITS * i) for i in range(PER_LONG)))

    def reached(block: pa.Table) -> np.ndarray:
        left, right = _sides(block)
        doc, group = block["doc"].to_numpy(), block["group"].to_numpy()
        signature, bands = _longs(block["signature"], SIGNATURE_LONGS), _longs(block["bands"], BANDS)
        key = np.int64(block["key"][0].as_py()).astype(np.uint64)
        hit = np.zeros(len(doc), bool)
        for lo in range(0, len(left), 128):
            rows = left[lo:lo + 128]
            far = group[rows][:, None] != group[right][None, :]
            if left is right:
                far &= doc[rows][:, None] < doc[right][None, :]
            i, j = np.nonzero(far)
            i, j = rows[i], right[j]
            z = signature[i] ^ signature[j]
            folded = z.copy()
            for k in range(1, LOW_BITS):
                folded |= z >> np.uint64(k)
            ok = HASHES - np.bitwise_count(folded & ones).sum(axis=1) >= least
            i, j = i[ok], j[ok]
            first = np.argmax(bands[i] == bands[j], axis=1)
            ok = bands[i, first] == key
            hit[i[ok]] = hit[j[ok]] = True
        return np.flatnonzero(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = reached(block)
            if len(rows):
                yield from block.select(["key", "i", "j", "own", "doc", "group"]).take(pa.array(rows)).combine_chunks().to_batches()

    return run


def _links_between_groups(percent: int):
    """Links between different groups of a block, found on full sets; those that connect nothing new are left out.

    Shingles that two members share are numbered; a 0-1 matrix of members and
    shingles times its transpose counts what every two members have in common.
    """

    def find(parent: dict[int, int], x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def links(block: pa.Table) -> list[tuple[int, int]]:
        left, right = _sides(block)
        doc, group = block["doc"].to_numpy(), block["group"].to_numpy()
        sets = block["shingles"].combine_chunks()
        ends = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        sizes = np.diff(ends)
        values = sets.flatten().to_numpy()
        row = np.repeat(np.arange(len(doc)), sizes)
        _, number, uses = np.unique(values, return_inverse=True, return_counts=True)
        common = uses > 1
        number, row = (np.cumsum(common) - 1)[number][common[number]], row[common[number]]
        width = int(common.sum())
        got = np.zeros((len(left), len(right)), np.float64)
        order = np.argsort(number, kind="stable")
        number, row = number[order], row[order]
        for lo in range(0, width, 4096):  # a stretch of shingles at a time
            a, b = np.searchsorted(number, [lo, lo + 4096])
            x = np.zeros((len(doc), 4096), np.float32)
            x[row[a:b], number[a:b] - lo] = 1
            got += x[left] @ x[right].T
        united = sizes[left][:, None] + sizes[right][None, :] - got
        i, j = np.nonzero((100 * got >= percent * united) & (group[left][:, None] != group[right][None, :]))
        parent: dict[int, int] = {}
        out = []
        for a, b in zip(left[i], right[j]):
            ga, gb = find(parent, int(group[a])), find(parent, int(group[b]))
            if ga != gb:
                parent[ga] = gb
                out.append((int(doc[a]), int(doc[b])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = links(block)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["x", "y"])

    return run


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).filter("x < y").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two documents are linked if ``100 * common >= percent * united`` shingles of
    ``width`` words.  ``component_id`` is the smallest id reachable by links,
    ``kept`` tells whether that is the document itself.

    A document of fewer words has one shingle, its whole sequence; one without
    words or text has none and is linked with nothing.  Rows that repeat an id
    are one document whose links are those of all its rows.  A row without an
    id is linked with nothing, has no component and is kept.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    digests = settle(texts.mapInArrow(_digests(width), _DIGEST), "minhash")
    sets = digests.filter("n_shingles > 0 and doc is not null")
    classes = settle(sets.groupBy("f1", "f2").agg(F.min("doc").alias("head")), "minhash-classes")
    heads = settle(
        sets.join(classes.withColumnRenamed("head", "doc"), ["f1", "f2", "doc"], "left_semi")
        .dropDuplicates(["f1", "f2"]).select("doc", "n_shingles", "bands", "signature"), "minhash-heads",
    )
    placed = sets.select("doc", "f1", "f2").join(classes, ["f1", "f2"])
    several = (  # an id with several texts ties their classes together
        placed.groupBy("doc").agg(F.min("head").alias("lo"), F.max("head").alias("hi")).filter("lo < hi").select("doc")
    )
    tied = placed.join(several, "doc", "left_semi").select(F.col("doc").alias("x"), F.col("head").alias("y"))

    in_bands = heads.select("doc", "n_shingles", F.explode("bands").alias("key"))
    keys = in_bands.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("held")).filter("members > 1")
    shared = settle(in_bands.drop("n_shingles").join(keys, "key"), "minhash-buckets")
    signatures = heads.select("doc", "signature")
    least = least_agreements(percent / 100)

    weight = shared.groupBy("doc").agg(F.sum("members").alias("weight"))
    weighed = shared.join(weight, "doc").select("key", "doc", "weight")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("less"))).alias("top"))
    pivots = pivots.select("key", (-F.col("top.less")).alias("pivot"))
    pairs = _ordered(shared.join(pivots, "key"), "doc", "pivot")
    pairs = (
        pairs.join(signatures.select(F.col("doc").alias("x"), F.col("signature").alias("sx")), "x")
        .join(signatures.select(F.col("doc").alias("y"), F.col("signature").alias("sy")), "y")
        .filter(agreements(F.col("sx"), F.col("sy")) >= least).select("x", "y")
    )
    links = confirmed(settle(pairs, "minhash-pairs"), texts, width, percent)

    groups = components(links, "x", "y", rounds=1)
    grouped = shared.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select(
        "key", "doc", "members", "held", F.coalesce("component", "doc").alias("group"))
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
    left_over = grouped.join(open_keys, "key")
    pieces = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    left_over = left_over.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int"))
    left_over = left_over.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"),
        F.when(F.col("piece") == F.col("other"), 0).when(F.col("piece") < F.col("other"), 1).otherwise(2).alias("own"),
        "doc", "group",
    )
    block = ["key", "i", "j"]
    reach = left_over.join(heads.select("doc", "signature", "bands"), "doc").repartition(*block).sortWithinPartitions(*block)
    reach = settle(reach.mapInArrow(_within_reach(least), "key long, i int, j int, own int, doc long, group long"), "minhash-reach")
    full = reach.join(sets_of(reach.select("doc").distinct(), texts, width), "doc").repartition(*block).sortWithinPartitions(*block)
    more = settle(full.select(*block, "own", "doc", "group", "shingles").mapInArrow(_links_between_groups(percent), "x long, y long"), "minhash-more-links")

    groups = components(links.unionByName(more).unionByName(tied), "x", "y")
    of_class = classes.join(groups.withColumnRenamed("node", "head"), "head", "left").select(
        "f1", "f2", F.coalesce("component", "head").alias("component_id"))
    return digests.withColumn("linked", F.expr("n_shingles > 0 and doc is not null")).join(
        of_class.withColumn("linked", F.lit(True)), ["f1", "f2", "linked"], "left",
    ).select(
        F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"),
        F.coalesce(F.col("doc") == F.coalesce("component_id", "doc"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one for each group of near copies: that of the smallest id, rows without an id last.

    Texts are compared, not ids: rows that repeat an id with different texts
    are documents of their own, as are rows without an id.  Of rows that repeat
    id and text one stays, of one id the text of the smallest hash.  Texts
    without words are linked with nothing; they all stay but for such repeats.
    """
    version = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    ids = docs.select(F.col(id_col).cast("long").alias("id"), version.alias("version"))
    repeated = settle(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select("id"), "repeated-ids")
    if repeated.isEmpty():
        heads = near_copies(docs, id_col, text_col, width, percent).filter("kept").select(F.col("doc_id").alias("head"))
        return docs.join(heads.hint("merge"), docs[id_col] == F.col("head"), "left_semi")
    several = ids.join(repeated, ids["id"].eqNullSafe(repeated["id"]), "left_semi").distinct()
    # Numbers below all ids, in ranges that each task counts by itself.
    parts = settle(several.repartitionByRange("id", "version").sortWithinPartitions("id", "version").withColumn("part", F.spark_partition_id())
                   .withColumn("place", F.monotonically_increasing_id() % (1 << 33)), "repeated-places")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    least = min(0, ids.agg(F.min("id")).first()[0] or 0)
    numbers = settle(parts.join(sizes, "part").select("id", "version", (F.lit(least - 1) - F.col("start") - F.col("place")).alias("number")), "repeated-numbers")

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    held = held.withColumn("id", F.col("row")[id_col].cast("long")).withColumn("version", F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit(""))))
    same = held["id"].eqNullSafe(numbers["id"]) & (held["version"] == numbers["version"])
    keyed = held.join(numbers, same, "left").select(
        "row", F.coalesce("number", held["id"]).alias("key"), F.col("number").isNotNull().alias("repeats"), F.col("row")[text_col].alias("text"))
    groups = near_copies(keyed, "key", "text", width, percent).select(F.col("doc_id").alias("key"), "component_id").distinct()
    named = groups.join(numbers.withColumnRenamed("number", "key"), "key", "left")
    order = F.struct((F.col("version").isNotNull() & F.col("id").isNull()).alias("without"), F.when(F.col("version").isNull(), F.col("key")).otherwise(F.col("id")).alias("id"), "version", "key")
    heads = named.groupBy("component_id").agg(F.min(order).alias("head")).select(F.col("head.key").alias("key"))
    kept = settle(keyed.join(heads.hint("merge"), "key", "left_semi").select("row", "key", "repeats"), "one-of-each")
    first = kept.filter("repeats").groupBy("key").agg(F.min("row").alias("row")).select("row.*")
    return kept.filter("not repeats").select("row.*").unionByName(first)


def sets_of(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the wanted documents.  Their number follows the corpus, so they are never broadcast."""
    return texts.join(wanted.hint("merge"), "doc", "left_semi").mapInArrow(_sets(width), "doc long, shingles array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; sets are made anew for documents in a pair only."""
    wanted = pairs.select(F.col("x").alias("doc")).unionByName(pairs.select(F.col("y").alias("doc"))).distinct()
    full = settle(sets_of(wanted, texts, width), "minhash-sets")
    both = (
        pairs.join(full.select(F.col("doc").alias("x"), F.col("shingles").alias("a")), "x")
        .join(full.select(F.col("doc").alias("y"), F.col("shingles").alias("b")), "y")
        .withColumn("common", F.size(F.array_intersect("a", "b")).cast("long"))
        .filter(100 * F.col("common") >= percent * (F.size("a") + F.size("b") - F.col("common")))
    )
    return settle(both.select("x", "y").distinct(), "minhash-links")
