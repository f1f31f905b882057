"""Compressed token files: exact round trips, checksums, spans, and the query's columns by brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from panelsmith.llm import rans, tokenfiles
from panelsmith.llm.packing import tokenizer_path
from panelsmith.llm.tokenizing import WordTokenizer
from panelsmith.storage import new_path
from tests.llm.test_text_operators import LONG, SCHEMA, awkward


def table_of(ids):
    return rans.frequencies(*np.unique(ids, return_counts=True))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, rans.SEGMENT, rans.SEGMENT + 1, rans.BLOCK - 1, rans.BLOCK])
def test_round_trip_of_a_block(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, rans.BLOCK) % 49_408).astype(np.uint32)
    table = table_of(ids)
    words, starts, states = rans.encode(ids[:n], table)
    assert (rans.decode(words, starts, states, n, table) == ids[:n]).all()
    for k in range(len(starts)):  # any segment from its checkpoint alone
        own = ids[:n][k * rans.SEGMENT:(k + 1) * rans.SEGMENT]
        assert (rans.decode(words, starts[k:k + 1], states[k:k + 1], len(own), table) == own).all()


def test_size_is_near_the_entropy():
    ids = (np.random.default_rng(1).zipf(1.5, rans.BLOCK) % 5000).astype(np.uint32)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    words, _, states = rans.encode(ids, table_of(ids))
    assert (words.nbytes + states.nbytes) * 8 < 1.05 * len(ids) * -(share * np.log2(share)).sum()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**20), st.integers(1, 10**12), min_size=1, max_size=60))
def test_frequencies_add_up(counts):
    ids = np.array(sorted(counts))
    table = rans.frequencies(ids, np.array([counts[i] for i in ids]))
    assert table.freq.sum() == 1 << table.scale and table.freq.min() >= 1


def test_one_id_alone():
    ids = np.full(1000, 7, np.uint32)
    assert (rans.decode(*rans.encode(ids, table_of(ids)), 1000, table_of(ids)) == ids).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=5))
def test_checksums_of_parts_make_the_whole(parts):
    whole, out = b"".join(parts), 0
    for k, part in enumerate(parts):
        out ^= tokenfiles.shifted(zlib.crc32(part), sum(map(len, parts[k + 1:])))
    assert out == zlib.crc32(whole)


@pytest.fixture(scope="module")
def written(spark):
    folder = new_path(spark, "test-token-files")
    tokenfiles.write(spark.createDataFrame(awkward(), SCHEMA).repartition(3), folder, shards=3)
    return folder


def brute_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in awkward()]


def test_documents_against_brute_force(spark, written):
    got = sorted(tokenfiles.read(spark, written, with_ids=True).collect(), key=lambda r: r.start)
    place = 0
    for r in got:
        assert r.start == place and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        place += r.n_tokens
    order = [(r.doc is not None, r.doc or 0) for r in got]
    assert order == sorted(order)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc, r.ids) for r in got], key=key) == sorted(brute_ids(), key=key)


def test_a_document_over_several_blocks(spark):
    folder = new_path(spark, "test-long-tokens")
    text = LONG * 3
    tokenfiles.write(spark.createDataFrame([(2, "b"), (1, text), (3, None)], "doc_id long, text string"), folder, shards=1)
    rows = sorted(tokenfiles.read(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 2]
    assert len(ids) > rans.BLOCK and rows[0].ids == ids
    assert rows[0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert [(r.doc, r.start) for r in rows] == [(1, 0), (2, len(ids)), (3, len(ids) + rows[1].n_tokens)]
    everything = [i for r in rows for i in r.ids]
    for lo, hi in ((0, 5), (rans.SEGMENT - 2, rans.SEGMENT + 3), (rans.BLOCK - 1, rans.BLOCK + 2), (len(everything) - 1, 10**9), (0, 10**9)):
        found = sorted(tokenfiles.span(spark, folder, lo, hi).collect(), key=lambda r: r.start)
        assert [i for r in found for i in r.ids] == everything[lo:hi]


def test_damage_is_noticed(spark, written):
    from pyspark.sql import functions as F

    broken = new_path(spark, "test-broken")
    blocks = spark.read.parquet(f"{written}/blocks")
    blocks.withColumn("words", F.expr("overlay(words placing X'00' from 2)")).write.parquet(f"{broken}/blocks")
    spark.read.parquet(f"{written}/frequencies").write.parquet(f"{broken}/frequencies")
    with pytest.raises(PythonException, match="damaged"):
        tokenfiles.read(spark, broken).collect()


def test_an_empty_table(spark):
    folder = new_path(spark, "test-no-tokens")
    tokenfiles.write(spark.createDataFrame([], SCHEMA), folder)
    assert tokenfiles.read(spark, folder).count() == 0 and tokenfiles.span(spark, folder, 0, 9).count() == 0


def test_blocks_are_decoded_together_and_give_the_same_ids(monkeypatch):
    """One call for whole blocks that follow each other, the short one behind them included."""
    rng = np.random.default_rng(5)
    sizes = [rans.BLOCK] * 3 + [70_001, rans.BLOCK, 5]
    ids = [rng.integers(0, 900, n).astype(np.uint32) for n in sizes]
    table = rans.frequencies(*np.unique(np.concatenate(ids), return_counts=True))
    rows = []
    for n, x in zip(sizes, ids):
        words, starts, states = rans.encode(x, table)
        packed = words.tobytes(), starts.astype("<i8").tobytes(), states.astype("<u8").tobytes()
        rows.append({"shard": 0, "first": 0, "n": n, "crc32": tokenfiles.checksum(n, *packed), **dict(zip(("words", "checkpoints", "states"), packed)), "docs": []})
    calls, decode = [], rans.decode
    monkeypatch.setattr(rans, "decode", lambda *a: calls.append(a[3]) or decode(*a))
    got = list(tokenfiles._decoded(pa.RecordBatch.from_pylist(rows), table))
    assert [k for k, _, _ in got] == list(range(6)) and all(np.array_equal(x, y) for (_, _, x), y in zip(got, ids))
    assert calls == [3 * rans.BLOCK + 70_001, rans.BLOCK + 5]


def test_signs_behind_a_word_need_no_new_merges():
    """A word with signs behind it takes the ids of its stem as learned."""
    words = WordTokenizer(tokenizer_path())
    asked = []

    class Model:
        def tokenize(self, part, model=words.model):
            asked.append(part)
            return model.tokenize(part)

    words.model = Model()
    texts = ["stem étude", "stem. étude! stem... Stem, étude$$$ stem's", "it's' é. Çà! word<| a<|endoftext|>. x_ _x ß?? 1a! İx. ab1."]
    for text in texts[:2]:
        assert words.encode(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked.count("stem") == 2 and len([p for p in asked if p.endswith("tude")]) == 1  # "stem's" is taken apart
    assert words.encode(texts[2]).tolist() == words.tokenizer.encode(texts[2], add_special_tokens=False).ids
