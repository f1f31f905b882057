"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

A document is a sparse vector of impacts, one for each term that is asked for.
Documents are placed by similarity, that is by the nearest of a few sampled
documents and then by length, and cut into shards.  In a shard each term has a
list of the documents that hold it, in that order, and the list is cut into
small blocks; a block stores the largest impact of each term over its
documents.  So an item's score for a block's summary is at least its score for
any document in the block.

Items are searched in two rounds.  The first takes the short lists of an item's
rarest terms, which gives the item a score that ten documents reach.  With it
the lists that can matter are chosen: when an item's terms are put in order of
the most they can add, the first of them, as long as their sum stays below that
score, cannot bring a document into the ten best.  The second round goes over
the blocks of the other lists and scores the documents of every block whose
summary reaches the score; all other blocks are skipped, and nothing else is.
All scores are whole numbers, so bounds are exact.

A block keeps the impacts of those terms that some item has together with the
list's own.

Items are taken in batches of bounded size, so their terms and weights fit a
task and the driver.  Documents are never collected: only counts by term, one
score by item and a few sampled documents are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.textbytes import mix
from panelsmith.storage import settle

MOST = 10  # documents for an item
ITEM_BYTES = 1 << 21  # of texts in a batch of items
BLOCK = 8  # documents of a block
SHARD = 2048  # documents of a shard, fewer if very many terms are asked for
CELLS = 1 << 23  # documents times terms of a shard
SAMPLE = 8192  # documents, on average, from which items get their first threshold
CLUSTERS = 64  # sampled documents that others are compared with
DIMENSIONS = 64  # to which vectors are hashed for that
FIRST = 5000  # postings of an item's rarest terms that the first round takes, or so many
FIRST_SHARE = 200  # documents for each of them, if that is more


def _term_bytes() -> bytes:
    """ASCII letters in lower case, digits and all bytes of other characters; the rest is white space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


TERM_BYTES = _term_bytes()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Items:
    """A batch of items: ids, the batch's terms, and each item's terms with how often they occur."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list[bytes | None]) -> Items:
        counted = [Counter(terms_of(t)) for t in texts]
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*counted)))}
        terms = [np.array(sorted(vocabulary[t] for t in c), np.int64) for c in counted]
        names = list(vocabulary)
        return cls(ids, vocabulary, terms, [np.array([c[names[k]] for k in own], np.int64) for c, own in zip(counted, terms)])


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo in range(0, batch.num_rows, 512):
                some = min(512, batch.num_rows - lo)
                sizes, own, terms, times = [], [0], [], []
                for k in range(lo, lo + some):
                    words = terms_of(texts[k].as_py())
                    held = Counter(map(vocabulary.get, words))
                    held.pop(None, None)
                    sizes.append(len(words))
                    terms += held
                    times += held.values()
                    own.append(len(terms))
                ends = pa.array(own, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + some)), batch.column(0).slice(lo, some), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                ], names=["row", "doc", "n", "terms", "times"])
                row += some
        pa.default_memory_pool().release_unused()

    return run


@dataclass
class Corpus:
    """What scores need to know of all documents: how many have terms, how many terms, and a weight for each term asked for."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length factor of each document and the impact of each of its terms."""
        m = np.array([25 + 75 * v * self.documents // self.length if v else 0 for v in n.tolist()], np.int64)
        return m, 1_000_000_000 * times // (1000 * times + 8 * np.repeat(m, sizes))


class Vectors:
    """A batch of documents as sparse vectors of impacts."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        ends = batch.column("terms").offsets.to_numpy()
        self.sizes = np.diff(ends)
        self.starts = ends[:-1] - ends[0]
        self.terms = batch.column("terms").flatten().to_numpy()
        self.row, self.doc = batch.column("row").to_numpy(), batch.column("doc")
        self.m, self.impacts = corpus.impacts(batch.column("n").to_numpy(), self.sizes, batch.column("times").flatten().to_numpy())

    def __len__(self) -> int:
        return len(self.row)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    def hashed(self, weights: np.ndarray) -> np.ndarray:
        """The weighted vectors in ``DIMENSIONS`` dimensions, of length one."""
        h = mix(np.arange(len(weights), dtype=np.uint64) + np.uint64(1))
        side, sign = (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0) * weights
        x = np.bincount(self.owner() * DIMENSIONS + side[self.terms], sign[self.terms] * self.impacts, len(self) * DIMENSIONS)
        x = x.reshape(len(self), DIMENSIONS)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _maxima_and_sample(corpus: Corpus, items: Items, share: float):
    """Rows (kind 0, term, its largest impact) and (kind 1, item, score of a sampled document)."""
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
    queries = [(t, r * corpus.weights[t]) for t, r in zip(items.terms, items.repeats)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = np.zeros(len(corpus.weights), np.int64)
        tops: list[list[int]] = [[] for _ in queries]
        full = np.zeros(len(corpus.weights), np.int64)
        for batch in batches:
            v = Vectors(batch, corpus)
            np.maximum.at(largest, v.terms, v.impacts)
            chosen = np.flatnonzero(mix(v.row) <= limit)
            if not len(chosen):
                continue
            sizes = v.sizes[chosen]
            held = ranges(v.starts[chosen], sizes)
            terms, impacts, owner = v.terms[held], v.impacts[held], np.repeat(np.arange(len(chosen)), sizes)
            for k, (own, weights) in enumerate(queries):
                full[own] = weights
                scores = np.bincount(owner, full[terms] * impacts, len(chosen)).astype(np.int64)
                full[own] = 0
                tops[k] = sorted([*tops[k], *scores[scores > 0].tolist()], reverse=True)[:MOST]
        seen = np.flatnonzero(largest)
        rows = [(0, t, n) for t, n in zip(seen.tolist(), largest[seen].tolist())] + [(1, k, s) for k, top in enumerate(tops) for s in top]
        if rows:
            kind, key, value = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(value, pa.int64())], names=["kind", "key", "value"])

    return run


def needed(items: Items, corpus: Corpus, largest: np.ndarray, thresholds: np.ndarray) -> list[np.ndarray]:
    """For each item the terms whose lists must be searched: without them a document stays below the threshold."""
    out = []
    for terms, repeats, threshold in zip(items.terms, items.repeats, thresholds):
        most = repeats * corpus.weights[terms] * largest[terms]
        order = np.argsort(most, kind="stable")
        out.append(np.sort(terms[order[np.cumsum(most[order]) >= threshold]]))
    return out


def rarest(items: Items, held: np.ndarray, documents: int) -> list[np.ndarray]:
    """For each item the terms of fewest documents, as many as the first round takes."""
    room, out = max(FIRST, documents // FIRST_SHARE), []
    for terms in items.terms:
        order = terms[np.argsort(held[terms], kind="stable")]
        out.append(np.sort(order[np.cumsum(held[order]) <= room]))
    return out


def together(items: Items, lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each term with a list the terms of the items that search the list."""
    held: dict[int, list[np.ndarray]] = {}
    for own, terms in zip(lists, items.terms):
        for t in own.tolist():
            held.setdefault(t, []).append(terms)
    return {t: np.unique(np.concatenate(h)) for t, h in held.items()}


def _placed(known: Measured):
    """Documents as vectors of impacts, with what they are placed by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Vectors(batch, known.corpus)
            some = np.flatnonzero(v.sizes)
            if not len(some):
                continue
            cluster = (v.hashed(known.corpus.weights) @ known.centres.T).argmax(axis=1).astype(np.int32)
            ends = pa.array(np.append(v.starts, len(v.terms)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(cluster), pa.array(v.m), pa.array(v.row), v.doc,
                pa.ListArray.from_arrays(ends, pa.array(v.terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(v.impacts, pa.int32())),
            ], names=["cluster", "m", "row", "doc", "terms", "impacts"]).take(pa.array(some))
        pa.default_memory_pool().release_unused()

    return run


def blocks_of(sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, coordinates: dict[int, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """The lists of one shard in blocks.

    For each block its term, its documents (``doc_sizes``, ``block_docs``) and its
    summary (``sum_sizes``, ``sum_terms``, ``sum_impacts``).
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    full = np.zeros((n, width), np.int32)
    full[owner, terms] = impacts
    order = np.argsort(terms, kind="stable")
    own, first, df = np.unique(terms[order], return_index=True, return_counts=True)
    found: dict[str, list] = {name: [] for name in ("term", "doc_sizes", "block_docs", "sum_sizes", "sum_terms", "sum_impacts")}
    for t, lo, size in zip(own.tolist(), first.tolist(), df.tolist()):
        columns = coordinates.get(t)
        if columns is None:
            continue
        docs = owner[order[lo:lo + size]]
        begins = np.arange(0, size, BLOCK)
        tops = np.maximum.reduceat(full[docs[:, None], columns], begins, axis=0)
        block, at = np.nonzero(tops)
        found["term"].append(np.full(len(begins), t))
        found["doc_sizes"].append(np.diff(np.append(begins, size)))
        found["block_docs"].append(docs)
        found["sum_sizes"].append(np.bincount(block, minlength=len(begins)))
        found["sum_terms"].append(columns[at])
        found["sum_impacts"].append(tops[block, at])
    return {name: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32) for name, parts in found.items()}


BLOCK_COLUMNS = ("term", "doc_sizes", "block_docs", "sum_sizes", "sum_terms", "sum_impacts")
SHARDS = "rows array<long>, docs array<long>, sizes array<int>, terms array<int>, impacts array<int>, " + ", ".join(f"{c} array<int>" for c in BLOCK_COLUMNS)


def _shards(coordinates: dict[int, np.ndarray], width: int):
    size = max(64, min(SHARD, CELLS // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ends = part.column("terms").offsets.to_numpy()
                terms, impacts = part.column("terms").flatten(), part.column("impacts").flatten()
                made = blocks_of(np.diff(ends), terms.to_numpy(), impacts.to_numpy(), coordinates, width)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([
                    one(part.column("row")), one(part.column("doc")), one(pa.array(np.diff(ends).astype(np.int32))), one(terms), one(impacts),
                    *(one(pa.array(made[c])) for c in BLOCK_COLUMNS),
                ], names=["rows", "docs", "sizes", "terms", "impacts", *BLOCK_COLUMNS])

    return run


class Shard:
    """A shard's documents and its blocks, the lists in order of their terms."""

    def __init__(self, batch: pa.RecordBatch, at: int = 0):
        column = lambda name: batch.column(name).slice(at, 1).flatten()
        whole = lambda name: column(name).to_numpy().astype(np.int64)
        self.rows, docs = column("rows").to_numpy(), column("docs")
        self.docs = docs.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.no_id = docs.is_null().to_numpy(zero_copy_only=False)
        self.sizes, self.terms, self.impacts = whole("sizes"), column("terms").to_numpy(), column("impacts").to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.term, self.doc_sizes, self.block_docs = (column(c).to_numpy() for c in ("term", "doc_sizes", "block_docs"))
        self.doc_sizes, self.sum_sizes = self.doc_sizes.astype(np.int64), whole("sum_sizes")
        self.doc_starts, self.sum_starts = np.cumsum(self.doc_sizes) - self.doc_sizes, np.cumsum(self.sum_sizes) - self.sum_sizes
        self.sum_terms, self.sum_impacts = column("sum_terms").to_numpy(), column("sum_impacts").to_numpy()

    def of_lists(self, terms: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        return ranges(lo, hi - lo)

    def bounds(self, chosen: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of each summary, at least that of any document in the block."""
        held = ranges(self.sum_starts[chosen], self.sum_sizes[chosen])
        return _sums(weights[self.sum_terms[held]] * self.sum_impacts[held], self.sum_sizes[chosen])

    def documents(self, chosen: np.ndarray) -> np.ndarray:
        """The documents of some blocks, each once."""
        return np.unique(self.block_docs[ranges(self.doc_starts[chosen], self.doc_sizes[chosen])])

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        held = ranges(self.starts[docs], self.sizes[docs])
        return _sums(weights[self.terms[held]] * self.impacts[held], self.sizes[docs])


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, none of them empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)


def _searched(corpus: Corpus, items: Items, lists: list[np.ndarray], thresholds: np.ndarray):
    """The best documents of each shard for each item, of all blocks that reach the threshold."""
    queries = [(t, r * corpus.weights[t]) for t, r in zip(items.terms, items.repeats)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(len(corpus.weights), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                shard, out = Shard(batch, at), []
                for k, (terms, own) in enumerate(queries):
                    chosen = shard.of_lists(lists[k])
                    if not len(chosen):
                        continue
                    weights[terms] = own
                    chosen = chosen[shard.bounds(chosen, weights) >= thresholds[k]]
                    docs = shard.documents(chosen)
                    scores = shard.scores(docs, weights)
                    weights[terms] = 0
                    docs, scores = docs[scores >= thresholds[k]], scores[scores >= thresholds[k]]
                    first = np.lexsort((shard.rows[docs], shard.docs[docs], -scores))[:MOST]
                    out.append((np.full(len(first), k), docs[first], scores[first]))
                if out:
                    k, docs, scores = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, pa.int64()), pa.array(shard.rows[docs]), pa.array(shard.docs[docs], mask=shard.no_id[docs]), pa.array(scores, pa.int64())],
                        names=["item", "row", "doc", "score"])

    return run


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST)


def _thresholds(tenth: list, before: np.ndarray) -> np.ndarray:
    out = before.copy()
    for r in tenth:
        out[r.item] = max(out[r.item], r.score)
    return out


def counted(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc, n, terms, times)``: every document's number of terms, and those that are asked for; written once."""
    pairs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return settle(pairs.mapInArrow(_counted(items.vocabulary), "row long, doc long, n long, terms array<int>, times array<long>"), "lexical-counts")


@dataclass
class Measured:
    """What is known of all documents before any list is built."""

    corpus: Corpus
    held: np.ndarray  # documents that hold each term
    largest: np.ndarray  # impact of each term
    thresholds: np.ndarray  # a score for each item that ten documents reach, 1 if not known
    centres: np.ndarray


def measured(vectors: DataFrame, items: Items) -> Measured | None:
    """None if no document holds a term that is asked for."""
    total = vectors.agg(F.sum(F.expr("if(n > 0, 1L, 0L)")).alias("documents"), F.sum("n").alias("length")).first()
    sample = vectors.filter(F.size("terms") > 0).orderBy(F.xxhash64("row"), "row").limit(CLUSTERS).toArrow().combine_chunks().to_batches()
    if not total.documents or not sample:
        return None
    held = np.zeros(len(items.vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as the batch has terms
        held[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    corpus = Corpus(total.documents, total.length, weights)
    seen = settle(vectors.mapInArrow(_maxima_and_sample(corpus, items, SAMPLE / total.documents), "kind int, key long, value long"), "lexical-maxima")
    largest = np.zeros(len(weights), np.int64)
    for r in seen.filter("kind = 0").groupBy("key").agg(F.max("value").alias("value")).collect():
        largest[r.key] = r.value
    order = Window.partitionBy("key").orderBy(F.desc("value"))
    tenth = seen.filter("kind = 1").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == MOST)
    thresholds = _thresholds(tenth.select(F.col("key").alias("item"), F.col("value").alias("score")).collect(), np.ones(len(items.ids), np.int64))
    return Measured(corpus, held, largest, thresholds, Vectors(sample[0], corpus).hashed(weights))


def placed(vectors: DataFrame, known: Measured) -> DataFrame:
    """Documents that hold a term as vectors of impacts, similar ones side by side; written once."""
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = vectors.mapInArrow(_placed(known), "cluster int, m long, row long, doc long, terms array<int>, impacts array<int>")
    order = ["cluster", "m", "row"]
    return settle(made.repartitionByRange(tasks, *order).sortWithinPartitions(*order), "lexical-vectors")


def index(vectors: DataFrame, items: Items, known: Measured, lists: list[np.ndarray]) -> DataFrame:
    """Shards of placed vectors with blocks of the given lists, written once."""
    made = vectors.select("row", "doc", "terms", "impacts").mapInArrow(_shards(together(items, lists), len(known.held)), SHARDS)
    return settle(made, "lexical-blocks")


def _search_batch(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame | None:
    if not items.vocabulary:
        return None
    vectors = counted(docs, items, id_col, text_col)
    known = measured(vectors, items)
    if known is None:
        return None
    vectors = placed(vectors, known)
    schema = "item long, row long, doc long, score long"

    def best(lists: list[np.ndarray], thresholds: np.ndarray) -> DataFrame:
        return _ranked(index(vectors, items, known, lists).mapInArrow(_searched(known.corpus, items, lists, thresholds), schema))

    tenth = best(rarest(items, known.held, known.corpus.documents), known.thresholds).filter(F.col("rank") == MOST)
    thresholds = _thresholds(tenth.select("item", "score").collect(), known.thresholds)
    found = best(needed(items, known.corpus, known.largest, thresholds), thresholds)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return found.join(names, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ten documents of highest score above 0 for each item, all if fewer.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and characters
    beyond ASCII.  Null and empty texts have none.  Ids are whole numbers.
    Every row of ``docs`` is a document of its own; of equal scores the smaller
    id comes first, rows without an id last.  Items that repeat id and text are
    one; those that repeat only the id are ranked apart.  Other columns are
    ignored.  Without documents or items the result is empty.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = size // ITEM_BYTES + 1
    found = []
    for k in range(batches):
        part = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(batches)) == k).toArrow().sort_by([("item", "ascending"), ("text", "ascending")])
        made = Items.of(part["item"].to_pylist(), part["text"].cast(pa.binary()).to_pylist())
        found.append(_search_batch(docs, made, id_col, text_col))
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
