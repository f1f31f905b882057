"""Line dedup, near copies, mixing, packing and token counts against brute force, on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelsmith.llm import linededup, minhash, mixing, packing, textbytes, tokencounts
from panelsmith.llm.components import components
from panelsmith.llm.tokenizing import word_tokenizer

LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
BASE = " ".join(f"word{i}" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, version int, words int, key string"


def awkward():
    """Nulls, empty and long texts, ties, repeated rows and ids, columns named as those used inside."""
    texts = [
        (0, "A shared line here\nown line of zero\nshort\nA shared line here"), (1, "  a SHARED line here\t\nother\nshort"), (2, None), (3, ""),
        (4, " \t\n "), (5, LONG), (6, LONG + " tail"), (7, BASE), (8, BASE.upper()), (9, BASE + " more"), (9, "another text of nine"), (10, BASE),
        (10, BASE), (None, BASE), (None, None), (11, "two words"), (12, "TWO  words"), (13, "Ünï çödé é́ 日本 語 a shared line here"),
        (14, "x\n" * 70 + "A shared line here\n" + "y\n" * 70), (15, "one"), (16, "a\x00b <|endoftext|> it's 12"),
    ]
    return [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}" if i != 4 else None, None, "r", "d", 1, 2, "k") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return lower(text or "").encode().split()


def test_lines_against_brute_force(docs, none):
    rows = awkward()
    first = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\f\r"))
            if i is not None and len(key) >= 10:
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(lower(x.strip(" \t\n\x0b\f\r")), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(docs).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[2] for r in got) > 3
    assert linededup.dedup_lines(none).count() == 0


def test_line_plan_is_native_and_spreads_a_shared_line(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line\nown line "), F.col("id").cast("string")).alias("text"))
    kept = linededup.dedup_lines(many)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert kept.filter("n_dropped = 1").count() == 3999
    assert kept.filter("n_dropped = 0").first().row.doc_id == 0


def brute_components(rows, width, percent):
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append((i, {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_copies_against_brute_force(docs, width, percent):
    got = minhash.near_copies(docs, width=width, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(awkward(), width, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_copies_of_nothing(none):
    assert minhash.near_copies(none).count() == 0


def test_chained_near_copies_that_share_no_centre(spark, monkeypatch):
    """Links in a chain, whose ends are far apart, and blocks smaller than the bucket."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(5)
    now, rows = [f"t{i}" for i in range(120)], []
    for i in range(40):
        rows.append((int(i * 7 % 41), " ".join(now)))
        now = list(now)
        for at in rng.choice(len(now), 3, replace=False):
            now[at] = f"n{i}-{at}"
    rows += [(100 + i, " ".join(f"z{k}" if k % 30 else f"z{k}-{i}" for k in range(120))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_copies(frame, width=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85)


def test_estimate_corrects_chance_agreement(spark):
    rng = np.random.default_rng(2)
    a, b = minhash._coefficients()
    found = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        y = np.concatenate([x[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
        low = [minhash.minima(v, a, b) & 15 for v in (x, y)]
        found.append((float((low[0] == low[1]).sum()),))
    mean = spark.createDataFrame(found, "n double").select(F.avg(minhash.estimate(F.col("n")))).first()[0]
    assert abs(mean - 800 / 1200) < 0.03


def test_packed_signatures_agree_where_low_bits_do(spark):
    rng = np.random.default_rng(4)
    lows = rng.integers(0, 16, (2, minhash.HASHES), dtype=np.uint64)
    lows[1, ::3] = lows[0, ::3]
    packed = (lows.reshape(2, minhash.SIGNATURE_LONGS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
    frame = spark.createDataFrame([(packed[0].tolist(), packed[1].tolist())], "x array<long>, y array<long>")
    assert frame.select(minhash.agreements(F.col("x"), F.col("y"))).first()[0] == int((lows[0] == lows[1]).sum())


def test_components_of_chains_stars_and_nulls(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(900, 1100)] + [(None, 3), (7000, 7000), (5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(301)} | {i: 900 for i in range(900, 1100)}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\r\x0b\x0cAbé日\x00.", max_size=12)), max_size=8), st.sampled_from([1, 5, 1 << 20]))
def test_words_of_bytes(texts, budget):
    seen, hashes = [], defaultdict(set)
    for part in textbytes.slices(pa.array(texts, pa.string()), budget):
        w = part.words()
        h = w.hashes()
        own = [bytes(part.data[a:b]) for a, b in zip(w.start, w.end)]
        seen += [own[lo:hi] for lo, hi in zip(w.first[:-1], w.first[1:])]
        for word, value in zip(own, h):
            hashes[word.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))].add(int(value))
    assert seen == [(t or "").encode().split() for t in texts]
    assert all(len(v) == 1 for v in hashes.values())
    assert len(set().union(*hashes.values())) == len(hashes)


def test_sliced_columns_and_nulls_with_bytes_under_them():
    column = pa.array(["skip me", "a b", None, "c"]).slice(1)
    assert [int(x) for p in textbytes.slices(column) for x in p.words().counts()] == [2, 0, 1]
    hidden = pa.Array.from_buffers(pa.string(), 2, [pa.py_buffer(b"\x02"), *pa.array(["xx yy", "z"]).buffers()[1:]])
    assert [int(x) for p in textbytes.slices(hidden) for x in p.words().counts()] == [0, 1]


def test_mixing_fills_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 400), ("b", "z", 600)], "top string, leaf string, tokens long")
    got = {(r.top, r.leaf): r.budget for r in mixing.leaf_budgets(leaves, ["top", "leaf"], {"top": {"a": 3}}, (1, 1), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 400, ("b", "z"): 600}
    got = {(r.top, r.leaf): r.budget for r in mixing.leaf_budgets(leaves, ["top", "leaf"], {"top": {"a": 3}}, (2, 5), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 593, ("b", "x"): 100, ("b", "z"): 100}  # 804: 603 and 201; x is full, y takes the rest


def test_mixing_awkward_rows(docs, none):
    levels = {"lang_level": F.col("lang"), "source_level": F.col("source")}
    units = mixing.units_of(docs, levels)
    counted = {(r.doc, r.n_tokens) for r in units.collect()}
    assert counted == {(i, len(words(t))) for i, t, *_ in awkward()}
    taken = mixing.choose(units, list(levels), {}, (1, 1), 2).collect()
    by_leaf = defaultdict(list)
    for r in taken:
        by_leaf[r.lang_level, r.source_level].append(r)
        assert r.n_tokens > 0 and r.used_tokens == min(r.n_tokens, r.leaf_budget - r.tokens_before)
    for rows in by_leaf.values():
        rows.sort(key=lambda r: r.tokens_before)
        assert [r.tokens_before for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert mixing.mixed(docs, levels, {}, (1, 1)).columns == docs.columns
    whole = mixing.mixed(docs, levels, {}, (1, 1)).count()
    assert whole == sum(1 for i, t, *_ in awkward() if words(t))
    assert mixing.mixed(none, levels, {}, (1, 2)).count() == 0


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, window=64, with_ids=True).collect()
    want = sorted((str(i), tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in awkward())
    pieces = sorted(rows, key=lambda r: (str(r.doc), r.doc_tokens, r.start))
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    by_sequence = defaultdict(list)
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_sequence[r.sequence_id].append(r)
    short = 0
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [0, *np.cumsum([r.length for r in held])[:-1]]
        short += sum(r.length for r in held) < 64
        assert sum(r.length for r in held) <= 64
    assert short <= 1
    once = {i: ids for i, ids in want if sum(j == i for j, _ in want) == 1}
    for i, ids in once.items():
        own = sorted((r for r in rows if str(r.doc) == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == list(ids)
    assert packing.pack(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=30))
def test_plan_keeps_to_the_histogram(histogram):
    made = packing.plan(histogram, 64)
    used = defaultdict(int)
    for lengths, n in made.combinations:
        assert sum(lengths) == 64
        for x in lengths:
            used[x] += n
    assert all(n <= histogram[x] for x, n in used.items())
    assert made.left_over == sum(x * (n - used[x]) for x, n in histogram.items())
    ranks = defaultdict(list)
    for length, lo, hi, _, _ in made.places():
        ranks[length] += range(lo, hi)
    assert all(sorted(r) == list(range(used[x])) for x, r in ranks.items())


def test_repeat_counts_solve_least_squares():
    histogram = {10: 30, 54: 30, 20: 12, 44: 7, 22: 5}
    columns = packing.fillings(histogram, 64)
    counts = packing.repeat_counts(columns, histogram)
    lengths = sorted(histogram)
    a = np.array([[c.count(x) for c in columns] for x in lengths], float)
    gradient = a.T @ (a @ counts - np.array([histogram[x] for x in lengths]))
    assert min(counts) >= 0
    assert (gradient > -0.1).all() and all(abs(g) < 0.1 for g, n in zip(gradient, counts) if n > 1e-6)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_word_tokenizer_equals_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    own = word_tokenizer(packing.tokenizer_path())
    assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def brute_sections(text, spans):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    data = text.encode()
    char = np.cumsum([(b & 0xC0) != 0x80 for b in data]) - 1
    counts, crossing, at = [0] * len(spans), [0] * len(spans), 0
    for token in tokenizer.encode(text, add_special_tokens=False).tokens:  # one letter for each byte
        held = [int(char[q]) for q in range(at, at + len(token)) if (data[q] & 0xC0) != 0x80] or [int(char[at])]
        at += len(token)
        parts = [sum(lo <= c < hi for c in held) for lo, hi in spans]
        if max(parts, default=0):
            best = parts.index(max(parts))
            counts[best] += 1
            crossing[best] += max(parts) < len(held)
    return counts, crossing


def test_sections_with_crossing_tokens(spark, none):
    text = "Hello wonderful worlds 日本語 é\n\n  naïve tokens\n"
    spans = [(0, 8), (8, 17), (19, 26), (26, len(text))]
    schema = "doc_id long, text string, spans array<struct<a:int,b:int>>, section int"
    frame = spark.createDataFrame([(1, text, spans, 0), (1, text, None, 0), (None, None, None, 0), (2, "", [], 0), (3, LONG, None, 0)], schema)
    got = tokencounts.section_tokens(frame, spans_col="spans").collect()
    mine = sorted((r for r in got if r.doc == 1), key=lambda r: (r.start, r.end))
    given_spans = [r for r in mine if (r.start, r.end) in spans]
    assert [(r.n_tokens, r.n_crossing) for r in given_spans] == list(zip(*brute_sections(text, spans)))
    assert sum(r.n_crossing for r in given_spans) >= 2
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    lines = list(zip([0, *ends], [*ends, len(text)]))
    by_line = {(r.start, r.end): (r.n_tokens, r.n_crossing) for r in mine if (r.start, r.end) in lines}
    assert [by_line[s] for s in lines] == list(zip(*brute_sections(text, lines)))
    assert [(r.section, r.start, r.end, r.n_tokens) for r in got if r.doc is None] == [(0, 0, 0, 0)]
    assert not [r for r in got if r.doc == 2]
    assert tokencounts.section_tokens(none).count() == 0


def test_sections_with_a_null_bound_hold_nothing(spark):
    schema = "doc_id long, text string, spans array<struct<a:int,b:int>>"
    spans = [(0, 5), (5, None), None, (None, 9), (6, 11)]
    got = tokencounts.section_tokens(spark.createDataFrame([(1, "Hello world and more", spans)], schema), spans_col="spans").collect()
    whole = tokencounts.section_tokens(spark.createDataFrame([(1, "Hello world and more", [(0, 5), (6, 11)])], schema), spans_col="spans").collect()
    found = [(r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in sorted(got, key=lambda r: r.section)]
    first, last = ((r.n_tokens, r.n_crossing) for r in sorted(whole, key=lambda r: r.section))
    assert found == [(0, 0, 5, *first), (1, 5, None, 0, 0), (2, None, None, 0, 0), (3, None, 9, 0, 0), (4, 6, 11, *last)]


def test_digest_of_kept_lines(docs):
    got = linededup.dedup_lines(docs).select("kept_text", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("h")).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.h for r in got)
