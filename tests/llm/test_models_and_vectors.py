"""Vector operators against brute force; learned models by exact values, gradients and held-out accuracy."""

import heapq
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelsmith.llm import embedding_dedup, hash_search, hidden_markov, langid, quality
from panelsmith.llm.textbytes import slices

VECTORS = "vec_id long, embedding array<float>, label int, head long, key long, kind int, n int"


def vectors():
    """Groups of near and equal vectors, and every kind of vector that takes no part."""
    rng = np.random.default_rng(11)
    rows, centre = [], rng.normal(size=(6, 24))
    for i in range(260):
        x = centre[i % 6] + rng.normal(size=24) * (0.05 if i % 3 else 0.9)
        rows.append((i, [float(np.float32(v)) for v in x], i % 6 if i % 13 else (i + 1) % 6))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(5, rows[5][1], rows[5][2]), (7, rows[60][1], rows[60][2])]  # repeated ids
    rows += [
        (2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] + [1.0] * 23, 1), (2004, [float("inf")] + [1.0] * 23, 1),
        (2005, rows[5][1], None), (None, rows[5][1], rows[5][2]), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [1.0, None] + [1.0] * 22, 1),
        (2009, [1e-30] * 24, 3), (2010, [1e30] * 24, 3),
    ]
    return [(*r, 9, 9, 9, 9) for r in rows]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), VECTORS).repartition(3).cache()


def good(x):
    return bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)


def brute_links(rows, cosine):
    links, root = [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    unit = [np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max()) if good(x) else None for _, x, *_ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        (a, x, la, *_), (b, y, lb, *_) = rows[i], rows[j]
        if a is None or b is None or la is None or la != lb or not good(x) or not good(y) or len(x) != len(y):
            continue
        if unit[i] @ unit[j] >= cosine:
            links[i] += 1
            links[j] += 1
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return sorted(((r[0], n, None if r[0] is None else find(r[0])) for r, n in zip(rows, links)), key=str)


@pytest.mark.parametrize("piece", [2048, 16])
def test_near_vectors_against_brute_force(spark, table, monkeypatch, piece):
    monkeypatch.setattr(embedding_dedup, "PIECE", piece)
    got = embedding_dedup.near_vectors(table).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(vectors(), 0.93)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    empty = embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and embedding_dedup.near_vectors(table.filter("vec_id = 2000")).first().kept


def partners(x, rng, cosine=0.93):
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * embedding_dedup.unit(away)


def cells_in_order(a, b, stop):
    """The walk of one vector, cell by cell: a heap holds the next cell of each row that was begun."""
    rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap = [(a[rows[0]] + b[columns[0]], 0, 0)] if len(a) and len(b) else []
    while heap and heap[0][0] <= stop:
        _, i, j = heapq.heappop(heap)
        yield int(rows[i]), int(columns[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[rows[i]] + b[columns[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[rows[i + 1]] + b[columns[0]], i + 1, 0))


def test_cells_are_visited_in_order_up_to_the_stop():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b, stop = rng.random(7) ** 2, rng.random(5) ** 2, rng.random() * 1.5
        cells = list(cells_in_order(a, b, stop))
        sums = [a[i] + b[j] for i, j in cells]
        assert sums == sorted(sums)
        depth, nearest = embedding_dedup.depths(a[None], b[None], stop)[0], np.argsort(b)
        assert set(cells) == {(i, int(j)) for i in range(7) for j in nearest[:depth[i]]}


def test_the_lossless_stop_reaches_every_partner():
    rng = np.random.default_rng(2)
    index = embedding_dedup.learn(embedding_dedup.unit(rng.normal(size=(3000, 32))), 100_000)
    x = embedding_dedup.unit(rng.normal(size=(3000, 32)))
    (ax, bx), (ay, by) = index.planes(x), index.planes(partners(x, rng))
    row = np.arange(len(x))
    assert (ax[row, ay.argmin(axis=1)] + bx[row, by.argmin(axis=1)] <= index.stop).all()


def test_a_target_recall_visits_fewer_cells(spark):
    rng = np.random.default_rng(2)
    sample = embedding_dedup.unit(rng.normal(size=(3000, 32)))
    whole, some = (embedding_dedup.learn(sample, 100_000, recall=r) for r in (None, 0.9))

    def share(index):
        a, b = index.planes(sample)
        return (a[:, :, None] + b[:, None, :] <= index.stop).mean()

    assert share(some) < 0.6 * share(whole)
    x = embedding_dedup.unit(rng.normal(size=(400, 32)))
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(np.concatenate([x, partners(x, rng, 0.9301)]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = lambda **how: embedding_dedup.near_vectors(table, **how).agg(F.sum("n_links")).first()[0] // 2
    assert links() == 400 and 0.8 * 400 < links(recall=0.9) <= 400


def test_halves_leave_no_pair_out():
    rng = np.random.default_rng(7)
    x = embedding_dedup.unit(rng.normal(size=(200, 12)))
    y = np.concatenate([partners(x, rng, c) for c in (0.9299, 0.9301, 0.99)] + [embedding_dedup.unit(rng.normal(size=(4000, 12)))])
    for part in (y, y[:600]):
        i, j = embedding_dedup._linked(x, part, 6, 0.93)
        assert set(zip(i, j)) == set(zip(*np.nonzero(x @ part.T >= 0.93)))


def test_pairs_across_a_border_of_codewords_are_linked(spark):
    """Near copies that differ along the line between two clusters, halfway between them."""
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(2, 16), 300, axis=0) + 0.02 * rng.normal(size=(600, 16))
    turn = np.radians([45 - 10.4, 45 + 10.4])
    between = np.stack([np.cos(turn), np.sin(turn)], axis=1) @ np.eye(2, 16)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, between]))]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=str) == brute_links(rows, 0.93)
    assert {r.vec_id: r.n_links for r in got.collect()}[601] == 1


def apart(x, y):
    """Euclidean distance, squares added one after another."""
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist()):
        total += (a - b) * (a - b)
    return math.sqrt(total)


@pytest.mark.parametrize("piece", [4096, 32])
def test_search_against_brute_force(spark, table, monkeypatch, piece):
    monkeypatch.setattr(hash_search, "PIECE", piece)
    monkeypatch.setattr(hash_search, "QUERY_PIECE", piece)
    rows = [(r[0], np.array(r[1], np.float64)) for r in vectors() if r[0] is not None and good(r[1])]
    got = hash_search.search(table, F.col("vec_id") % 20 == 0).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    hit = total = 0
    for q, x in [r for r in rows if r[0] % 20 == 0]:
        near = sorted((apart(x, y), v) for v, y in rows if v != q and len(x) == len(y))[:10]
        mine = [found[q, k + 1] for k in range(len(near))]
        assert (q, len(near) + 1) not in found
        assert [(v, s) for v, s in mine] == sorted(mine, key=lambda m: (m[1], m[0]))
        every = {(v, apart(x, y)) for v, y in rows if len(x) == len(y)}
        assert set(mine) <= every
        hit += len(Counter(v for v, _ in mine) & Counter(v for _, v in near))
        total += len(near)
    assert hit >= 0.97 * total
    assert hash_search.search(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert hash_search.search(table, F.lit(False)).count() == 0


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    s, k = hidden_markov.STATES, hidden_markov.CLASSES
    first, move, emit = rng.random(s), rng.random((s, s)), rng.random((k, s))
    return hidden_markov.Model(first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_is_the_sum_over_all_paths():
    model = small_model()
    seqs = [np.array([3, 9, 3]), np.array([1]), np.zeros(0, int), np.array([5, 5, 7, 1])]
    for seq, got in zip(seqs, model.log10_likelihood(seqs)):
        total = 0.0
        for path in itertools.product(range(hidden_markov.STATES), repeat=len(seq)):
            p = 1.0
            for t, (s, k) in enumerate(zip(path, seq)):
                p *= (model.first[s] if t == 0 else model.move[path[t - 1], s]) * model.emit[k, s]
            total += p
        assert got == pytest.approx(np.log10(total), rel=1e-12)


def test_long_texts_score_alike():
    model, rng = small_model(1), np.random.default_rng(3)
    for n in (4097, 5000, 4096 + 257):
        seq = rng.integers(0, hidden_markov.CLASSES, n)
        a = model.first * model.emit[seq[0]]
        total = np.log10(a.sum())
        for k in seq[1:]:
            a = (a / a.sum() @ model.move) * model.emit[k]
            total += np.log10(a.sum())
        assert model.log10_likelihood([seq])[0] == pytest.approx(total, rel=1e-10)


def test_expected_counts_and_likelihood_rise():
    model, rng = small_model(2), np.random.default_rng(5)
    seqs = [rng.integers(2, 40, rng.integers(1, 30)) for _ in range(50)]
    begins = np.ones(len(seqs), bool)
    first, move, emit = model.expected(seqs, begins)
    assert first.sum() == pytest.approx(len(seqs))
    assert move.sum() == pytest.approx(sum(len(s) - 1 for s in seqs))
    assert emit.sum(axis=1)[:64] == pytest.approx(np.bincount(np.concatenate(seqs), minlength=64))
    before = model.log10_likelihood(seqs).sum()
    for _ in range(4):
        first, move, emit = model.expected(seqs, begins)
        model = hidden_markov.Model(first / first.sum(), move / move.sum(axis=1, keepdims=True), (emit + 1e-12) / (emit + 1e-12).sum(axis=0))
        now = model.log10_likelihood(seqs).sum()
        assert now > before - 1e-9
        before = now


def test_scores_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(hidden_markov, "BLOCK_TOKENS", 50)
    lower = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    rows = [(i, f"The cat {i % 7} sat\ton the MAT é {'dog ' * (i % 5)}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "unheard-of words"), (3, rows[3][1]), (None, "the cat"), (103, "long " * 9000)]
    schema = "doc_id long, text string, doc string, learn string, block int, total int"
    frame = spark.createDataFrame([(*r, "d", "l", 1, 2) for r in rows], schema).repartition(3)
    got = hidden_markov.scored(frame, hidden_markov.training_rows(F.col("doc_id"))).collect()
    tokens = [(i, [lower(w) for w in (t or "").encode().split()] + [None]) for i, t in rows]
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    counts = Counter(w for i, ws in tokens if learned(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens), key=str)
    assert sorted(((r.doc, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty = spark.createDataFrame([], schema)
    assert hidden_markov.scored(empty, F.lit(True)).count() == 0
    alone = hidden_markov.scored(frame.filter("doc_id = 102"), F.lit(False)).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score, alone.score) == (0, 0, 0, 0)


def test_word_probabilities_add_up():
    """Over all known words and the unknown one, given any history, the model's probabilities sum to 1."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 500)
    kind = rng.integers(2, 60, 500)
    masses = np.bincount(kind, counts + 0.5, hidden_markov.CLASSES)
    tokens = np.bincount(kind, counts, hidden_markov.CLASSES)
    unknown = 0.5 / (counts.sum() + 0.5 * 501)
    s = hidden_markov.STATES
    model = hidden_markov.maximised(rng.random(s), rng.random((s, s)), rng.random((hidden_markov.CLASSES, s)) * (tokens > 0)[:, None], tokens / tokens.sum(), unknown)
    state = rng.dirichlet(np.ones(s))
    p = (model.emit[kind] @ state) * (counts + 0.5) / masses[kind]
    assert p.sum() + model.emit[0] @ state == pytest.approx(1)


def test_attention_gradients():
    rng = np.random.default_rng(6)
    first = np.array([0, 3, 4, 9])
    x, y = rng.normal(size=(9, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel.new(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))

    def loss():
        p = model.forward(x, first)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(x, first, y)
    for name, weights in model.weights.items():
        for at in [tuple(rng.integers(0, n) for n in weights.shape) for _ in range(6)]:
            held = weights[at]
            weights[at] = held + 1e-6
            up = loss()
            weights[at] = held - 1e-6
            down = loss()
            weights[at] = held
            assert found[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    assert model.forward(x, first)["share"].sum() == pytest.approx(3)


def test_passages_by_hand():
    text = "Ab cd! " * 70 + "é"
    part = next(slices(pa.array([text, None, "  "])))
    x, first = quality.passages(part)
    assert first.tolist() == [0, 3, 4, 5]
    assert not x[3:].any()
    cut = ("Ab cd! " * 32).rstrip()
    assert x[0][quality.UPPER] == pytest.approx(32 / len(cut))
    assert x[0][8 + quality.SIGNS.index("!")] == pytest.approx(32 / len(cut))
    assert x[0][quality.CLASSES + 2] == pytest.approx(2 / 64)
    assert x[2][quality.LEAD] > 0


AWKWARD = [(1, None), (2, ""), (3, "123 456 !!"), (None, "the house and the garden"), (4, "日本語 テキスト"), (5, "x" * 300_000), (5, "und der die das")]


def test_languages(spark):
    words = {"en": "the of and to in that is was he for", "de": "der die und das ist nicht ein zu den mit", "fr": "le la les des et est une que dans pour"}
    rng = np.random.default_rng(9)
    rows = [(100 + i, " ".join(rng.choice(words[k].split(), rng.integers(3, 60))), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(i, t, None) for i, t in AWKWARD]
    schema = "doc_id long, text string, lang string, row string, score string, doc string, guess string"
    frame = spark.createDataFrame([(*r, "r", "s", "d", "g") for r in rows], schema).repartition(3)
    got = langid.identify(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.row.lang is not None:
            assert r.lang_pred == r.row.lang and not r.rejected
        if r.row.text is None or not any(c.isalpha() for c in r.row.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert langid.identify(frame.limit(0)).count() == 0
    nothing = langid.identify(frame.filter("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_training_reads_no_held_out_row(spark):
    """Changing held-out texts and languages changes no other prediction."""
    rows = [(i, ("the and of " if i % 2 else "der und die ") * (3 + i % 5), "en" if i % 2 else "de") for i in range(80)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    spoilt = [(i, "le la les" if held(i) else t, "xx" if held(i) else k) for i, t, k in rows]
    schema = "doc_id long, text string, lang string"
    a, b = ({r.row.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, schema)).collect()} for x in (rows, spoilt))
    assert all(a[i] == b[i] for i, *_ in rows if not held(i))
    assert {k for k, _ in b.values()} <= {"en", "de"}


def test_quality(spark):
    rng = np.random.default_rng(4)
    plain = lambda: " ".join(rng.choice("river stone house evening table quiet morning".split(), 90))
    rows = [(100 + i, plain() if i % 3 else plain()[:200] + " BUY!! NOW!! $$$ ### " * 12, int(i % 3 > 0)) for i in range(240)]
    docs = [(i, t) for i, t, _ in rows] + AWKWARD
    frame = spark.createDataFrame([(*r, "r", "s", "l") for r in docs], "doc_id long, text string, row string, score string, label string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7777, None), (100, 0), (8888, 1)], "doc_id long, quality int")
    model = quality.train(frame, labels)
    got = {(r.row.doc_id, r.row.text): r.score for r in quality.score(frame, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    held = [(s >= 0.5) == bool(q) for i, t, q in rows if zlib.crc32(str(i).encode()) % 3 == 1 for s in [got[i, t]]]
    assert np.mean(held) > 0.95
    assert got[1, None] == pytest.approx(got[2, ""])
    assert quality.train(frame, labels.limit(0)) is None
    assert quality.score(frame, None).first().score == 0.5
    assert quality.score(frame.limit(0), model).count() == 0


def test_lettered_texts_of_no_learned_language_are_rejected(spark):
    """An unlearned language and gibberish go whatever their softmax says; clean texts stay, short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs, langid.training_rows(F.col("doc_id")))
    rng = np.random.default_rng(3)
    gibberish = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(20)) for _ in range(40)]
    polish = "w tym roku nie było już żadnego powodu aby przejść obok tego domu bez słowa ponieważ wszyscy mieszkańcy wyjechali nad morze"
    finnish = "tänä vuonna ei ollut enää mitään syytä kulkea talon ohi sanomatta sanaakaan koska kaikki asukkaat olivat lähteneet meren rannalle"
    russian = "в этом году уже не было причин проходить мимо дома не сказав ни слова потому что все жители уехали к морю"
    strange = spark.createDataFrame([(t,) for t in [*gibberish, polish, finnish, russian]], "text string")
    assert langid.predict(strange, model).filter("not rejected").count() == 0
    held_out = docs.filter("crc32(cast(doc_id as string)) % 4 = 2")
    short = held_out.select(F.substring("text", 1, 40).alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    assert langid.predict(short, model).filter("rejected").count() <= 0.02 * short.count()


def test_a_block_whose_visitors_reach_no_cell_has_no_links():
    index = embedding_dedup.MultiIndex(4, 2, np.array([[0.5, 0], [0.8, 0]]), np.array([[0, 0.8], [0.6, 0]]), 1.0)
    x = [[0.8, 0, 0.6, 0], [0.6, 0, 0, 0.8], [0.6, 0, 0, 0.8]]  # the first lies, the others visit its first codeword
    n = lambda *v: pa.array(v, pa.int64())
    block = pa.RecordBatch.from_arrays(
        [n(1, 1, 1), n(0, 0, 0), n(0, 0, 0), pa.array([0, 1, 1], pa.int32()), pa.array([1, 1, 1], pa.int32()), n(7, 8, 9), n(7, 8, 9), n(5, 5, 5), n(1, 1, 1), pa.array(x)],
        names=["key", "i", "j", "kind", "code", "head", "h1", "space", "weight", "embedding"])
    assert list(embedding_dedup._compare(index, 0.93)(iter([block]))) == []


def test_the_first_states_take_every_training_text():
    rng = np.random.default_rng(3)
    share = np.full(hidden_markov.CLASSES, 1 / hidden_markov.CLASSES)
    texts = [rng.integers(50 + 1000 * (i % 2), 90 + 1000 * (i % 2), rng.integers(1, 300)).astype(np.int32) for i in range(1500)]
    model = hidden_markov.unlike(share, 1e-6)
    for _ in range(hidden_markov.GROUPINGS):
        first, _, emit = hidden_markov.shared_out(model, texts)
        assert first.sum() == len(texts) and emit.sum() == sum(map(len, texts))
        model = hidden_markov.loose(emit, first, share, 1e-6)
    assert (np.minimum(emit[50:90].sum(axis=0), emit[1050:1090].sum(axis=0)) == 0).all()  # no state holds both kinds


def test_recursions_bear_rare_words_between_rescalings():
    """Sequences of every length around the rescaling, of words of 1e-18, against recursions rescaled at each token."""
    model, rng = small_model(4), np.random.default_rng(8)
    emit = model.emit.copy()
    emit[20:40] *= 1e-18 * rng.random((20, 1))
    model = hidden_markov.Model(model.first, model.move, emit)
    seqs = [rng.integers(20, 60, n) for n in range(1, 4 * hidden_markov.RESCALED)] * 2
    begins = rng.random(len(seqs)) < 0.5
    first, move, emit = np.zeros_like(model.first), np.zeros_like(model.move), np.zeros_like(model.emit)
    for seq, begin, got in zip(seqs, begins, model.log10_likelihood(seqs)):
        for start, keep in [(model.first, False), (model.first if begin else model.usual, True)]:
            ahead, total = [], 0.0
            for t, k in enumerate(seq):
                a = (start if t == 0 else ahead[-1] @ model.move) * model.emit[k]
                total += np.log10(a.sum())
                ahead.append(a / a.sum())
            if not keep:
                assert got == pytest.approx(total, rel=1e-12)
        back = np.ones(hidden_markov.STATES)
        for t in range(len(seq) - 1, -1, -1):
            held = ahead[t] * back / (ahead[t] * back).sum()
            emit[seq[t]] += held
            if t:
                onward = model.emit[seq[t]] * back
                pairs = np.outer(ahead[t - 1], onward) * model.move
                move += pairs / pairs.sum()
                back = model.move @ onward
                back /= back.sum()
        first += held * begin
    for got, want in zip(model.expected(seqs, begins), (first, move, emit)):
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("whole", [True, False])
def test_a_task_sends_one_row_a_class(whole):
    """Not one for every class and state: eight times as many rows went through the shuffle of each pass."""
    rng = np.random.default_rng(2)
    words, ids = rng.integers(0, 2**62, 5000), rng.integers(0, 5000, 20_000).astype("<i4")
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a))
    block = pa.RecordBatch.from_arrays([
        one(np.arange(200) % 5 > 0), one(np.full(200, 100, np.int32)), pa.array([pa.compress(ids.tobytes(), "zstd", asbytes=True)]), one(words),
    ], names=["learn", "sizes", "ids", "vocabulary"])
    sent, = hidden_markov._expectations(small_model(5), whole)(iter([block]))
    classes = hidden_markov.class_of(words.view(np.uint64))[ids[np.repeat(np.arange(200) % 5 > 0, 100)]]
    at = sent["at"].to_numpy()
    assert len(at) == len(set(at)) <= 1 + hidden_markov.STATES + len(set(classes))
    rows = np.zeros((1 + hidden_markov.STATES + hidden_markov.CLASSES, hidden_markov.STATES))
    rows[at] = np.stack([c.to_numpy() for c in sent.columns[1:]], axis=1)
    assert rows[0].sum() == pytest.approx(160)
    assert rows[1:1 + hidden_markov.STATES].sum() == pytest.approx(0 if whole else 160 * 98)  # two sequences a text
    assert rows[1 + hidden_markov.STATES:].sum(axis=1) == pytest.approx(np.bincount(classes, minlength=hidden_markov.CLASSES))
