"""Lexical search and hard negatives against brute force; bounds that never lose a row."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsmith.llm import hard_negatives, lexical
from tests.llm.test_models_and_vectors import VECTORS, vectors
from tests.llm.test_text_operators import SCHEMA, awkward

ITEMS = "item_id long, text string, doc long, row long"


def corpus():
    """Awkward rows, and texts of few words so that scores tie and lists are long."""
    rng = np.random.default_rng(12)
    rows = awkward()
    for i in range(600):
        words = [f"w{int(v)}" for v in np.minimum(rng.zipf(1.4, int(rng.integers(1, 40))), 60)]
        rows.append((100 + i, " ".join(words) if i % 3 else "w1 w2 W3, w4", None, None, None, "r", "d", 1, 2, "k"))
    return rows


def asked():
    return [(1, "w1 w1 w2 w30", 1, 1), (2, "Word1 word2 word39; two WORDS", 1, 1), (3, None, 1, 1), (4, "", 1, 1), (5, "nothing-like-this zzz", 1, 1),
            (6, "日本 çödé w5", 1, 1), (6, "日本 çödé w5", 1, 1), (7, " ".join(f"w{i}" for i in range(60)), 1, 1), (7, "x59999", 1, 1), (None, "w3", 1, 1)]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, most=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    n, total = sum(1 for v in lengths if v), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for (doc, c), length in zip(held, lengths):
            m = 25 + 75 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if no else doc, -score) for k, (score, no, doc) in enumerate(sorted(scored)[:most])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r))


@pytest.mark.parametrize("block,sample,item_bytes", [(32, 8192, 1 << 21), (4, 40, 64)])
def test_search_against_brute_force(spark, monkeypatch, block, sample, item_bytes):
    monkeypatch.setattr(lexical, "SAMPLE", sample)
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)  # several batches of items
    monkeypatch.setattr(lexical, "SHARD", 64 if sample < 100 else 2048)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "FIRST", sample)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = lexical.search(docs, spark.createDataFrame(asked(), ITEMS)).collect()
    want = brute_search([r[:2] for r in corpus()], [r[:2] for r in asked()])
    assert order(tuple(r) for r in got) == order(want)


def test_search_of_empty_tables(spark):
    docs, none = spark.createDataFrame(corpus()[:3], SCHEMA), spark.createDataFrame([], SCHEMA)
    items, no_items = spark.createDataFrame(asked(), ITEMS), spark.createDataFrame([], ITEMS)
    for d, i in ((none, items), (docs, no_items), (docs.filter("text is null"), items), (docs, items.filter("item_id = 3"))):
        found = lexical.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_most_blocks_are_skipped_and_none_that_counts(spark):
    """Documents of many topics and lengths: blocks whose documents are too long or hold too little are left alone."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        topic = int(rng.integers(3, 6))
        words = [f"t{topic}x{int(v)}" for v in rng.integers(0, 40, int(rng.integers(4, 160)))] + ["the"] * int(rng.integers(1, 4)) + [f"s{int(rng.integers(0, 8))}"]
        rows.append((i, " ".join(words)))
    items = lexical.Items.of([1, 2], [b"t3x1 t3x2 t3x3 t3x4 the s1", b"t4x1 t4x2 t4x3 t4x4 the s2"])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors_ = lexical.counted(docs, items, "doc_id", "text")
    known = lexical.measured(vectors_, items)
    lists = lexical.needed(items, known.corpus, known.largest, known.thresholds)
    the = items.vocabulary[b"the"]
    assert not any(the in own for own in lists)  # every document has it: the list is never read
    every = visited = 0
    for batch in lexical.index(lexical.placed(vectors_, known), items, known, lists).toArrow().to_batches():
        for shard in (lexical.Shard(batch, at) for at in range(batch.num_rows)):
            assert shard.doc_sizes.max(initial=0) <= lexical.BLOCK
            for k, (own, repeats) in enumerate(zip(items.terms, items.repeats)):
                weights = np.zeros(len(items.vocabulary), np.int64)
                weights[own] = repeats * known.corpus.weights[own]
                chosen = shard.of_lists(lists[k])
                bounds = shard.bounds(chosen, weights)
                tenth = np.sort(shard.scores(shard.documents(chosen), weights))[-10:].min(initial=2**62)
                for c, bound in zip(chosen, bounds):
                    assert bound >= shard.scores(shard.documents(np.array([c])), weights).max(initial=0)
                every += len(chosen)
                visited += int((bounds >= tenth).sum())
    assert visited < 0.7 * every


def ints(x):
    return [math.floor(256 * v) for v in x]


def brute_negatives(rows):
    taking = [(i, ints(x), label) for i, x, label in rows
              if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)
              and sum(v * v for v in ints(x)) < 2**56]
    out = []
    for a, x, label in taking:
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in taking if i != a and len(x) == len(y)]
        for p, i, other in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fit)]
    return out


def more_vectors():
    rows = [r[:3] for r in vectors()]
    rng = np.random.default_rng(5)
    rows += [(3000 + i, [float(v) for v in rng.normal(size=24)], int(i % 4)) for i in range(200)]
    rows += [(4000 + i, rows[10][1], 2 + i % 2) for i in range(60)]  # ties over two labels
    rows += [(5000, [1e4] * 24, 1), (5050, [2e5] * 24, 1), (5001, [2e5] * 24, 2), (5100, [], 2), (5150, [], 1), (5101, [], 1), (5200, [-1.0, -2.0], 1)]
    return rows


@pytest.mark.parametrize("piece,at_once,anchors", [(32_768, 4096, 1 << 18), (60, 16, 3)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, piece, at_once, anchors):
    for name, value in (("PIECE", piece), ("AT_ONCE", at_once), ("ANCHORS", anchors)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = more_vectors()
    df = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], VECTORS).repartition(3)
    got = hard_negatives.mine(df, lambda i: i % 50 == 0).collect()
    want = brute_negatives(rows)
    assert len(want) > 50
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_hard_negatives_of_an_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), lambda i: i % 50 == 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 40), st.integers(0, 2**31))
def test_summaries_bound_every_score(width, seed):
    rng = np.random.default_rng(seed)
    a, b = (np.floor(rng.normal(size=(6, width)) * 10.0 ** rng.integers(0, 5)) for _ in range(2))
    (ma, sa), (mb, sb) = hard_negatives.summaries(a), hard_negatives.summaries(b)
    score, at, gap = a @ b.T, 0, None
    for segments in hard_negatives.LEVELS:
        own = slice(at, at + segments)
        at += segments
        middle, reach = ma[:, own] @ mb[:, own].T, sa[:, own] @ sb[:, own].T
        slack = 1e-9 * np.abs(score).max(initial=1) + 1e-6 * (reach.max(initial=0) + 1)
        assert (score <= middle + reach + slack).all() and (score >= middle - reach - slack).all()
        assert gap is None or (reach <= gap + slack).all()  # each level is at least as tight
        gap = reach


def rows_of(q, ids, labels):
    means, spreads = hard_negatives.summaries(q)
    return hard_negatives.Rows(pa.table({
        "row": ids, "id": ids, "label": labels, "width": np.full(len(q), q.shape[1], np.int32), "size": np.sqrt((q * q).sum(axis=1)),
        "q": pa.array(list(q.astype(np.int64))), "means": pa.array(list(means)), "spreads": pa.array(list(spreads))}))


def test_bounds_spare_exact_scores_of_clustered_vectors():
    """Vectors whose segments have means of their own: few pairs need the exact score."""
    rng = np.random.default_rng(8)
    centres = np.repeat(rng.normal(size=(40, 16)) * 100, 4, axis=1)
    q = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64)) * 5)
    b, a = rows_of(q, np.arange(3000), np.zeros(3000, np.int64)), rows_of(q[:20], np.arange(20), np.zeros(20, np.int64))
    found = [[] for _ in range(20)]
    pairs = hard_negatives.best(a, b, a.id[:, None] != b.id, np.arange(20), np.full(20, -np.inf), np.full(20, np.inf), 5, found)
    score = (q[:20] @ q.T).astype(np.int64)
    for i, f in enumerate(found):
        assert f == sorted((-int(s), j) for j, s in enumerate(score[i]) if j != i)[:5]
    assert pairs < 0.1 * 20 * 3000
