"""The operators' queries over the given tables, each beside its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.llm import embedding_dedup, hard_negatives, hash_search, hidden_markov, langid, lexical, linededup, minhash, mixing, packing, quality, tokencounts, tokenfiles
from panelsmith.llm.tables import table
from panelsmith.plans.registry import Build, Query
from panelsmith.storage import new_path

LLM_REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(build: Build) -> Build:
        LLM_REGISTRY[build.__name__] = Query(build.__name__, build, sql)
        return build

    return add


@query("""
WITH RECURSIVE taking AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y
    FROM taking a JOIN taking b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 93e-2
), reached AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), least AS (
    SELECT x AS vec_id, min(y) AS y FROM reached GROUP BY x
), counts AS (
    SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(vec_id, y), vec_id) AS component_id, coalesce(vec_id <= y, TRUE) AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
""")
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked with others of their label at cosine 0.93 or more."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


@query()
def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likelihood under a model learned from four of five folds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scores = hidden_markov.scored(docs, hidden_markov.training_rows(F.col("doc_id")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return scores.withColumnRenamed("doc", "doc_id").select("doc_id", held_out.alias("held_out"), *[c for c in scores.columns if c not in ("doc", "learned")])


@query("""
WITH taking AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), placed AS (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1),
               lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda s, x: s + x)) AS score
    FROM taking q JOIN taking c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM placed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
""")
def op3_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth."""
    return hash_search.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("doc", "doc_id")


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair tokens of every line of every document, attributed by their characters."""
    return tokencounts.section_tokens(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("doc", "doc_id")


@query(r"""
WITH units AS (
    SELECT DISTINCT doc_id, text, 'd' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4, 0) AS domain,
           coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
    FROM documents
), leaves AS (
    SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM units GROUP BY ALL
), d AS (
    SELECT domain, 2 * sum(tokens)::BIGINT AS capacity, CASE domain WHEN 'd0' THEN 2 ELSE 1 END AS weight,
           (SELECT sum(tokens)::BIGINT * 3 // 5 FROM leaves) AS parent_budget
    FROM leaves GROUP BY domain
), d_level AS (
    SELECT *, (parent_budget - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, capacity
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (ORDER BY capacity / weight, capacity ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS l
    FROM d
), d_budget AS (
    SELECT domain, least(capacity, floor(max(l) OVER () * weight)::BIGINT) AS budget FROM d_level
), g AS (
    SELECT domain, lang, 2 * sum(tokens)::BIGINT AS capacity,
           CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(budget) AS parent_budget
    FROM leaves JOIN d_budget USING (domain) GROUP BY domain, lang
), g_level AS (
    SELECT *, (parent_budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, capacity
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, capacity
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS l
    FROM g
), g_budget AS (
    SELECT domain, lang, least(capacity, floor(max(l) OVER (PARTITION BY domain) * weight)::BIGINT) AS budget FROM g_level
), s AS (
    SELECT domain, lang, source, tokens, 2 * tokens AS capacity, CASE source WHEN 'src0' THEN 3 ELSE 1 END AS weight, budget AS parent_budget
    FROM leaves JOIN g_budget USING (domain, lang)
), s_level AS (
    SELECT *, (parent_budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, capacity
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, capacity
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS l
    FROM s
), s_budget AS (
    SELECT domain, lang, source, tokens, least(capacity, floor(max(l) OVER (PARTITION BY domain, lang) * weight)::BIGINT) AS budget
    FROM s_level
), placed AS (
    SELECT u.*, b.tokens, b.budget, e.epoch, e.epoch * b.tokens + coalesce(sum(u.n_tokens) OVER (
               PARTITION BY u.domain, u.lang, u.source, e.epoch ORDER BY md5('mix:' || e.epoch || ':' || u.doc_id), u.doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tokens_before
    FROM units u JOIN s_budget b USING (domain, lang, source) CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS epoch) e
    WHERE u.n_tokens > 0
)
SELECT doc_id, epoch, domain, lang, source, n_tokens, budget AS leaf_budget, tokens_before::BIGINT AS tokens_before,
       least(n_tokens, budget - tokens_before)::BIGINT AS used_tokens
FROM placed WHERE tokens_before < budget
""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in each epoch so that three fifths of all tokens are mixed to the target weights."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    taken = mixing.choose(mixing.units_of(docs, mixing.levels()), list(mixing.levels()), mixing.WEIGHTS, share=(3, 5), epochs=2)
    return taken.withColumnRenamed("doc", "doc_id").drop("version")


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of two of three folds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return quality.score(docs, model).select(
        "row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(r"""
WITH RECURSIVE sequences AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM sequences
), members AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), least AS (
    SELECT x AS doc_id, min(y) AS y FROM reached GROUP BY x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(doc_id, y), doc_id) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM sets LEFT JOIN least USING (doc_id)
""")
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by three-word shingles of similarity 0.85 or more."""
    return minhash.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, percent=85)


@query("""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
    SELECT k.doc_id, k.line, k.place, coalesce(k.doc_id > f.first_doc, FALSE) AS gone
    FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, those dropped as repeated, and the digest of what stays."""
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    named = langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False))
    return named.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("""
WITH taking AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM taking a JOIN taking b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), lambda i: i % 50 == 0)


@query(r"""
WITH asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), occurrences AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), held AS (
    SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS length FROM held GROUP BY doc_id
), corpus AS (
    SELECT count(*)::BIGINT AS docs, sum(length)::BIGINT AS total FROM lengths
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, corpus GROUP BY term
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * length * docs) // total))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query()
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written compressed and read back."""
    folder = new_path(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    return tokenfiles.read(spark, folder).withColumnRenamed("doc", "doc_id")
