"""Scoring texts by a hidden Markov model over their words.

Words are counted exactly over all training texts.  The hidden states do not
emit words but classes of words, a fixed number of buckets of the words' hash;
within its class every state gives a word its share of the class's counts:

    P(word | state) = P(class | state) * (c + 0.5) / (sum of c + 0.5 over the class)

Words never seen in training are one class that every state emits with the
probability that the counts leave for them.  So the states' table has a bounded
size whatever the vocabulary, and the model is a proper distribution over words.

Texts are read once into blocks of about two million tokens: the words of a
block are numbered, and only its distinct words travel to be counted and come
back with their counts.  Training takes no sample.  Whole training texts are
first shared out among the states by their words, some times over, and then
Baum-Welch runs over all of them: each task adds up expected counts over its
blocks, Spark adds them up over the tasks.  For training, texts are cut into
sequences of 64 tokens; a score is the exact likelihood of the whole text by
the scaled forward recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.blocks import blocks
from panelsmith.llm.textbytes import slices
from panelsmith.storage import settle

STATES = 8
CLASSES = 8192  # 0: unknown words, 1: the end of a text
BLOCK_TOKENS = 2_000_000
SEQUENCE = 64
GROUPINGS, ROUNDS = 4, 6  # passes over all training texts
SMOOTHING = 1000.0  # so many tokens of every state are spread as all tokens are
SIDE_BY_SIDE = 2048  # training sequences walked at once
RESCALED = 8  # a recursion's values are brought back to a sum of 1 after so many tokens; a token takes some 20 decimal powers at worst
SUMS = np.ones((STATES, STATES))  # a product with it has a row's sum in every place
LONG = 4096  # longer texts are scored by products over stretches of them
OF_STATES = [f"s{s}" for s in range(STATES)]
END = np.uint64(0x1D8E4E27C47D124F)


def class_of(words: np.ndarray) -> np.ndarray:
    found = (words % np.uint64(CLASSES - 2)).astype(np.int32) + 2
    found[words == END] = 1
    return found


@dataclass(frozen=True)
class Model:
    first: np.ndarray  # (states,) of a text's first token
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)

    @property
    def usual(self) -> np.ndarray:
        """The states in the long run, which a training sequence from the middle of a text begins with."""
        share = self.first
        for _ in range(64):
            share = share @ self.move
        return share

    def expected(self, seqs: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts over sequences of classes: of first states (where ``begins``), moves and emissions."""
        first, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
        usual = self.usual
        order = np.argsort([-len(s) for s in seqs], kind="stable")
        for lo in range(0, len(seqs), SIDE_BY_SIDE):
            some = order[lo:lo + SIDE_BY_SIDE]
            self._expected([seqs[i] for i in some], begins[some], usual, first, move, emit)
        return first, move * self.move, emit

    def _expected(self, seqs, begins, usual, first, move, emit) -> None:
        """Adds the counts of sequences that come longest first; ``move`` lacks the factor of the move itself."""
        sizes = np.array([len(s) for s in seqs])
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(seqs)
        longest = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(longest), "left")
        # Tokens lie by their place in the sequence: row[t] holds those of place t.
        ends = np.cumsum(active)
        row = [slice(hi - n, hi) for hi, n in zip(ends, active)]
        classes = np.concatenate([flat[starts[:n] + t] for t, n in enumerate(active)]).astype(np.int64)
        seen = np.take(self.emit, classes, axis=0)
        ahead = np.empty_like(seen)
        scale = {}
        for t, n in enumerate(active):
            a = ahead[row[t]]
            if t == 0:
                np.multiply(np.where(begins[:, None], self.first, usual), seen[row[t]], out=a)
            else:
                np.matmul(ahead[row[t - 1]][:n], self.move, out=a)
                a *= seen[row[t]]
            if t % RESCALED == RESCALED - 1:
                scale[t] = 1 / (a @ SUMS)
                a *= scale[t]
        back_move = np.ascontiguousarray(self.move.T)
        later = None
        for t in range(longest - 1, -1, -1):
            held = ahead[row[t]]
            n, m = active[t], active[t + 1] if t + 1 < longest else 0
            back = np.empty((n, STATES))
            if m:
                onward = seen[row[t + 1]]  # not needed again
                onward *= later
                if t + 1 in scale:
                    onward *= scale[t + 1]
                move += held[:m].T @ onward
                np.matmul(onward, back_move, out=back[:m])
            back[m:] = 1 / (held[m:] @ SUMS)  # sequences that end here
            held *= back
            later = back
        first += ahead[row[0]][begins].sum(axis=0)
        every = np.ascontiguousarray(ahead.T)
        for s in range(STATES):
            emit[:, s] += np.bincount(classes, every[s], CLASSES)

    def log10_likelihood(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Of each whole sequence of classes, by the scaled forward recursion; an empty one has 0."""
        out = np.zeros(len(seqs))
        sizes = np.array([len(s) for s in seqs], np.int64)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._long(seqs[i])
        short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
        short = short[np.argsort(-sizes[short], kind="stable")]
        for lo in range(0, len(short), 4096):
            some = short[lo:lo + 4096]
            size = sizes[some]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            flat = np.concatenate([seqs[i] for i in some])
            total, last = np.zeros(len(some)), np.ones(len(some))
            active = np.append(np.searchsorted(-size, -np.arange(size[0]), "left"), 0)
            a = None
            for t, n in enumerate(active[:-1]):
                e = np.take(self.emit, flat[begin[:n] + t], axis=0)
                a = self.first * e if a is None else np.multiply(a[:n] @ self.move, e, out=e)
                if t % RESCALED == RESCALED - 1:
                    s = a @ SUMS
                    a /= s
                    total[:n] += np.log10(s[:, 0])
                m = active[t + 1]
                if m < n:  # texts that end here
                    last[m:n] = a[m:].sum(axis=1)
            out[some] = total + np.log10(last)
        return out

    def _long(self, seq: np.ndarray, stretch: int = 256) -> float:
        """The same for one long sequence: stretches become matrices side by side, then follow one another."""
        a = self.first * self.emit[seq[0]]
        total = np.log10(a.sum())
        a = a / a.sum()
        rest = seq[1:]
        n = -(-len(rest) // stretch)
        grid = np.full(n * stretch, -1)
        grid[:len(rest)] = rest
        grid = grid.reshape(n, stretch)
        step = np.tile(np.eye(STATES), (n, 1, 1))
        logs = np.zeros(n)
        for t in range(stretch):
            on = grid[:, t] >= 0  # all but the last stretch, which ends early
            m = n if on[-1] else n - 1
            if not m:
                break
            moved = (step[:m].reshape(-1, STATES) @ self.move).reshape(m, STATES, STATES) * self.emit[grid[:m, t]][:, None, :]
            top = moved.max(axis=(1, 2))
            step[:m] = moved / top[:, None, None]
            logs[:m] += np.log10(top)
        for i in range(n):
            a = a @ step[i]
            total += logs[i] + np.log10(a.sum())
            a = a / a.sum()
        return float(total)


def cut(seqs: list[np.ndarray], length: int = SEQUENCE) -> tuple[list[np.ndarray], np.ndarray]:
    """Training sequences, and which of them begin a text."""
    parts, begins = [], []
    for s in seqs:
        for lo in range(0, len(s), length):
            parts.append(s[lo:lo + length])
            begins.append(lo == 0)
    return parts, np.array(begins, bool)


def maximised(first: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray, unknown: float) -> Model:
    """The model that fits expected counts; ``share`` is the classes' share of all known tokens."""
    emit = emit.copy()
    emit[0] = 0
    known = (emit + SMOOTHING * share[:, None]) / (emit.sum(axis=0) + SMOOTHING * share.sum())
    known *= 1 - unknown
    known[0] = unknown
    return Model((first + 1) / (first + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), known)


def loose(emit: np.ndarray, first: np.ndarray, share: np.ndarray, unknown: float) -> Model:
    """A model whose states keep to themselves, with ``emit`` as expected counts."""
    sticky = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return maximised(first, 1000 * sticky, emit, share, unknown)


def unlike(share: np.ndarray, unknown: float) -> Model:
    """The model before any text is seen: states that like and dislike classes by a fixed draw."""
    taste = np.random.default_rng(STATES).choice([0.5, 1.5], (CLASSES, STATES))
    return loose(1e6 * share[:, None] * taste, np.ones(STATES), share, unknown)


def shared_out(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of first states and emissions when each whole text goes to the state that likes its words best."""
    flat, sizes = np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    likes = [np.add.reduceat(state[flat], starts) for state in np.ascontiguousarray(np.log(model.emit + 1e-300).T)]
    best = np.argmax(likes, axis=0)
    emit = np.bincount(flat * STATES + np.repeat(best, sizes), minlength=CLASSES * STATES)
    return np.bincount(best, minlength=STATES).astype(float), np.zeros((STATES, STATES)), emit.reshape(CLASSES, STATES).astype(float)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    docs, learn, sizes, words, held = [], [], [], [], 0

    def full() -> pa.RecordBatch:
        numbered = pa.array(np.concatenate(words).view(np.int64)).dictionary_encode()
        vocabulary, ids = numbered.dictionary, numbered.indices.to_numpy()
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        size = np.concatenate(sizes)
        return pa.RecordBatch.from_arrays([
            pa.array([block]), one(pa.concat_arrays(docs)), one(pa.concat_arrays(learn)), one(pa.array(size.astype(np.int32))),
            pa.array([pa.compress(ids.astype("<i4").tobytes(), "zstd", asbytes=True)], pa.binary()), one(vocabulary),
        ], names=["block", "docs", "learn", "sizes", "ids", "vocabulary"])

    for batch in batches:
        for part in slices(batch.column(1)):
            found = part.words()
            size = found.counts() + 1
            own = np.full(int(size.sum()), END)
            ends = np.zeros(len(own), bool)
            ends[np.cumsum(size) - 1] = True
            own[~ends] = found.hashes()
            docs.append(batch.column(0).slice(part.first, len(part)))
            learn.append(batch.column(2).slice(part.first, len(part)))
            sizes.append(size)
            words.append(own)
            held += len(own)
            if held >= BLOCK_TOKENS:
                yield full()
                block += 1
                docs, learn, sizes, words, held = [], [], [], [], 0
    if held:
        yield full()


def _unpacked(row: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of a block's texts, whether they may be learned from, and the numbers of their words."""
    sizes = row["sizes"][i].values.to_numpy().astype(np.int64)
    learn = row["learn"][i].values.to_numpy(zero_copy_only=False)
    n = int(sizes.sum())
    return sizes, learn, np.frombuffer(pa.decompress(row["ids"][i].as_py(), n * 4, "zstd", asbytes=True), "<i4")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, learn, ids = _unpacked(batch, i)
            words = batch["vocabulary"][i].values.to_numpy().view(np.uint64)
            counts = np.bincount(ids[np.repeat(learn, sizes)], minlength=len(words))
            yield pa.RecordBatch.from_arrays([
                pa.array(words.view(np.int64)), pa.array(np.full(len(words), batch["block"][i].as_py())), pa.array(np.arange(len(words), dtype=np.int32)),
                pa.array(class_of(words)), pa.array(counts.astype(np.int64)),
            ], names=["word", "block", "number", "class", "n"])


def _expectations(model: Model, whole: bool = False):
    """Sums over a task's training texts: of whole texts shared out among states, or expected ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, learn, ids = _unpacked(batch, i)
                classes = class_of(batch["vocabulary"][i].values.to_numpy().view(np.uint64))[ids]
                texts = np.split(classes, np.cumsum(sizes)[:-1])
                texts = [t for t, ok in zip(texts, learn) if ok]
                if texts:
                    found = shared_out(model, texts) if whole else model.expected(*cut(texts))
                    totals = found if totals is None else tuple(a + b for a, b in zip(totals, found))
        if totals is not None:
            rows = np.vstack(totals)
            at = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *map(pa.array, rows[at].T)], names=["at", *OF_STATES])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its words' counts over all training texts and their classes, in the order of their numbers."""
    packed = lambda column, kind: pa.compress(column.to_numpy().astype(kind).tobytes(), "zstd", asbytes=True)
    for block in blocks(batches, ("block",)):
        yield pa.RecordBatch.from_arrays([
            pa.array([block["block"][0].as_py()]), pa.array([block.num_rows], pa.int32()),
            pa.array([packed(block["total"], "<i8")], pa.binary()), pa.array([packed(block["class"], "<i4")], pa.binary()),
        ], names=["block", "words", "totals", "classes"])


def _scores(model: Model, masses: np.ndarray, n_train: int, v_train: int):
    """Scores of each block's texts."""
    base = np.log10(n_train + 0.5 * (v_train + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sizes, learn, ids = _unpacked(batch, r)
                n = batch["words"][r].as_py()
                read = lambda c, kind, width: np.frombuffer(pa.decompress(batch[c][r].as_py(), n * width, "zstd", asbytes=True), kind)  # noqa: E731, B023
                count = read("totals", "<i8", 8)
                kind = np.where(count > 0, read("classes", "<i4", 4), 0).astype(np.int32)
                log_count = np.log10(count + 0.5)
                within = np.where(count > 0, log_count - np.log10(masses[kind]), 0.0)
                starts = np.cumsum(sizes) - sizes
                chain = model.log10_likelihood(np.split(kind[ids], starts[1:]))
                yield pa.RecordBatch.from_arrays([
                    batch["docs"][r].values, pa.array(learn), pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64)[ids], starts)),
                    pa.array(np.add.reduceat((log_count - base)[ids], starts)), pa.array(chain + np.add.reduceat(within[ids], starts)),
                ], names=["doc", "learn", "n_tokens", "n_known", "base_score", "score"])

    return run


def training_rows(doc_id: Column, folds: int = 5, held_out: int = 1) -> Column:
    """Rows that may be learned from; a row without an id may not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != held_out, F.lit(False))


def scored(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, learned, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Learns from the ``allowed`` rows.  A null text counts as empty and is the
    end token alone.  Rows that repeat an id count each.  With nothing to learn
    from, every token is unknown and every score 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), allowed.alias("learn"))
    read = settle(rows.mapInArrow(
        _to_blocks, f"block long, docs array<{kind}>, learn array<boolean>, sizes array<int>, ids binary, vocabulary array<long>"), "word-blocks")

    counted = read.select("block", "learn", "sizes", "ids", "vocabulary").mapInArrow(
        _word_counts, "word long, block long, number int, class int, n long")
    # Summed before it is joined back: a common word has a row in every block, more than one task should hold.
    words_of = settle(counted.groupBy("word", "class").agg(F.sum("n").alias("total")), "word-totals", "zstd")
    counted = counted.select("word", "block", "number", "class").join(words_of.select("word", "total").hint("merge"), "word").drop("word")
    counted = settle(counted, "word-counts", "zstd")
    per_class = words_of.filter("total > 0").groupBy("class").agg(
        F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()  # at most CLASSES rows
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        tokens[r["class"]], words[r["class"]] = r.tokens, r.words
    n_train, v_train = int(tokens.sum()), int(words.sum())
    unknown = 0.5 / (n_train + 0.5 * (v_train + 1))

    if n_train:
        share = tokens / n_train

        def counted_by(model: Model, whole: bool) -> list[np.ndarray]:
            sums = read.select("learn", "sizes", "ids", "vocabulary").mapInArrow(
                _expectations(model, whole), "at int, " + ", ".join(f"{s} double" for s in OF_STATES))
            found = sums.groupBy("at").agg(*[F.sum(s).alias(s) for s in OF_STATES]).toArrow()  # at most the size of the model
            rows = np.zeros((1 + STATES + CLASSES, STATES))
            rows[found["at"].to_numpy()] = np.stack([found[s].to_numpy() for s in OF_STATES], axis=1)
            return [rows[0], rows[1:1 + STATES], rows[1 + STATES:]]

        model = unlike(share, unknown)
        for _ in range(GROUPINGS):
            first, _, emit = counted_by(model, True)
            model = loose(emit, first, share, unknown)
        for _ in range(ROUNDS):
            model = maximised(*counted_by(model, False), share, unknown)
    else:
        emit = np.zeros((CLASSES, STATES))
        emit[0] = 1
        model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 1 / STATES), emit)

    in_order = counted.select("block", "number", "class", "total").repartition("block").sortWithinPartitions("block", "number")
    totals = in_order.mapInArrow(_totals, "block long, words int, totals binary, classes binary")
    ready = read.select("block", "docs", "learn", "sizes", "ids").join(totals.hint("merge"), "block")
    done = ready.mapInArrow(_scores(model, np.maximum(tokens + 0.5 * words, 0.5), n_train, v_train),
                            f"doc {kind}, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc", F.col("learn").alias("learned"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
