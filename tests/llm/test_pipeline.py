"""The pipeline's stages one after another, and each query's columns on the small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelsmith.llm import langid, linededup
from panelsmith.llm.queries import LLM_REGISTRY
from panelsmith.session import return_memory
from tests.compare import differences, sql_connection
from tests.llm.test_text_operators import SCHEMA, awkward

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
COLUMNS = {  # fixed values: the columns that each query must return
    "op1_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_hidden_markov": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3_hash_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", [n for n, q in LLM_REGISTRY.items() if q.sql])
def test_query_with_sql(spark, name):
    query = LLM_REGISTRY[name]
    want = sql_connection(FOLDER).sql(query.sql)
    assert differences(query.build(spark, FOLDER).toPandas(), want.df()) == []


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_without_sql(spark, name):
    got = LLM_REGISTRY[name].build(spark, SMALL)
    assert COLUMNS[name].items() <= dict(got.dtypes).items()
    table = "embeddings" if name in ("op1_embedding_dedup", "op3_hash_search") else "documents"
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert got.count() >= rows or name == "op3_hash_search"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], FOLDER)
        seen.append(out.cache())
    for out in seen[1:-1]:
        assert out.columns == corpus_pipeline.COLUMNS
    named, lines, near, mixed, packed = seen[1:]
    assert named.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert lines.count() == named.count()
    assert near.count() < lines.count() and near.groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert 0.7 < mixed.agg(F.sum("n_chars")).first()[0] / near.agg(F.sum("n_chars")).first()[0] < 0.9
    assert packed.select("doc_id").distinct().count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n != 2048").count() <= 1


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=str)


def test_stages_on_awkward_rows(spark):
    """Every stage against plain Python, row by row."""
    rows = [(i, t, lang, source, n) for i, t, lang, source, n, *_ in awkward()]
    docs = spark.createDataFrame([r + ("r", "d", 1, 2, "k") for r in rows], SCHEMA)
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    named = corpus_pipeline.language_id(spark, docs, FOLDER)
    judged = langid.identify(plain).filter("not rejected").select("row.*")
    assert rows_of(named) == rows_of(judged)
    assert {r[1] for r in rows_of(named)} <= {r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}

    lines = corpus_pipeline.line_dedup(spark, docs, FOLDER)
    assert lines.count() == len(rows) and lines.filter("text is null").count() == 0

    near = corpus_pipeline.near_dedup(spark, plain, FOLDER)
    groups = [{5, 6}, {7, 8, 9, 10}]  # of ids; nine's other text is no near copy
    want = []
    for i, t, lang, source, _ in {r for r in rows}:
        if t and t.split()[:2] == ["word0", "word1"]:  # the base text, repeated with and without an id
            keep = i == 7
        elif i in groups[0]:
            keep = i == 5
        elif i is None or (t and t.startswith("WORD0")):
            keep = not t
        elif t == "TWO  words":
            keep = False
        else:
            keep = True
        if keep:
            want.append((i, t, lang, source))
    assert rows_of(near) == sorted(want, key=str)

    mixed = corpus_pipeline.mixing_stage(spark, plain, FOLDER)
    given = [r[:4] for r in rows]
    for r in rows_of(mixed):
        given.remove(r)  # each row at most as often as it was given
        assert r[1] and r[1].split()
    packed = corpus_pipeline.packing_stage(spark, plain, FOLDER)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packed.filter("start = 0").collect()) == sorted((r[0] is None, r[0] or 0) for r in rows)

    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_texts_of_one_id_stay_apart(spark):
    """An id with two texts, one of which another id repeats: both texts stay, once each."""
    alpha, beta = " ".join(f"alpha{i}" for i in range(30)), " ".join(f"beta{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, alpha, "en", "s", 1), (1, beta, "en", "s", 1), (2, beta + " x", "en", "s", 1), (None, alpha, "en", "s", 1), (1, alpha, "en", "s", 1),
         (None, "one more text here", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (None, None, "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    got = rows_of(corpus_pipeline.near_dedup(spark, docs, FOLDER))
    want = [(1, alpha), (1, beta), (3, None), (4, ""), (None, "one more text here"), (None, None)]
    assert [(r[0], r[1]) for r in got] == sorted(want, key=str)


def test_copies_count_in_the_mix(spark):
    """Equal rows hold as many tokens as there are rows, and no more of them come back than were budgeted."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, "en", "src0", 1)] * 50 + [(i, text + f" {i}", "en", "src0", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixing_stage(spark, docs, FOLDER).collect()
    tokens = sum(len(r.text.split()) for r in out)
    total = sum(len(r[1].split()) for r in rows)
    assert total * 4 // 5 <= tokens < total * 4 // 5 + 101 and 78 <= len(out) <= 82
    first = corpus_pipeline.mixing_stage(spark, docs.repartition(5), FOLDER)
    assert sorted(map(str, first.collect())) == sorted(map(str, out))


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    named = langid.identify(docs).filter("crc32(cast(row.doc_id as string)) % 4 = 2")
    assert named.agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert named.filter("rejected").count() == 0


def test_bitmaps_are_smaller_than_the_lines_they_drop(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    dropped = linededup.dropped_lines(docs)
    assert linededup.bitmaps(dropped).select(F.sum(F.size("words"))).first()[0] <= dropped.count()


def test_stages_return_freed_memory(spark, monkeypatch):
    """Every stage gives back what the driver's JVM has freed outside its heap, and goes on where that can't be done."""
    assert return_memory(spark)
    called = []
    monkeypatch.setattr(corpus_pipeline, "return_memory", lambda session: called.append(session) or False)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
    assert called == [spark] * len(corpus_pipeline.STAGES)
