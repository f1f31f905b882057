"""Repeated lines of a corpus, found with DataFrame functions only.

Every line long enough to count is turned into a 128-bit hash of its key.  The
narrow rows (hash, document, position) are range-partitioned by hash and
sorted by document and position inside, so that one pass streams over them and
sees the first document of each hash before all others.  No text travels with
them: what comes back is one compressed bitmap for each document that loses
lines.

A line that a third of all documents share is spread over *slices* of its
documents, which the ranges may cut between.  A slice drops what comes after
its own first document; only the lines of each slice's first document, at most
as many documents for a hash as there are slices, meet in a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.storage import settle

WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_BITS = 63  # lines of one bitmap word; 63 keeps every word a non-negative long

MIN_CODE_POINTS = 10


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: stripped of ASCII white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_version(text: Column) -> Column:
    """Tells rows apart that repeat a document's id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """One row ``(doc, version, line)`` for each line that an earlier document holds.

    A key of at least ``min_code_points`` code points stays in the smallest
    document id that holds it, there at every place, and is dropped everywhere
    else.  Rows without an id neither lose lines nor make others lose them.
    """
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    lines = (
        own.select("doc", text_version(F.col("text")).alias("version"), F.posexplode(lines_of(F.col("text"))).alias("line", "content"))
        .withColumn("key", line_key(F.col("content")))
        .filter(F.length("key") >= min_code_points)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
                F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int").alias("slice"), "doc", "version", "line")
    )
    lines = settle(lines, "line-hashes")

    by_slice = Window.partitionBy("h1", "h2", "slice").orderBy("doc", "line")
    in_slice = (
        lines.repartitionByRange(slices, "h1", "h2", "slice")
        .withColumn("slice_first", F.first("doc").over(by_slice))
    )
    in_slice = settle(in_slice, "line-slices")
    late = in_slice.filter("doc > slice_first").select("doc", "version", "line")
    by_hash = Window.partitionBy("h1", "h2").orderBy("doc", "line")
    heads = (
        in_slice.filter("doc = slice_first").select("h1", "h2", "doc", "version", "line")
        .withColumn("first_doc", F.first("doc").over(by_hash))
        .filter("doc > first_doc").select("doc", "version", "line")
    )
    return late.unionByName(heads)


def bitmaps(dropped: DataFrame) -> DataFrame:
    """Compressed bitmaps: for each document only the words in which a line is dropped.

    ``words`` holds structs (word, bits) in order; bit b of word w stands for
    line 63 w + b and is set when that line goes.
    """
    placed = dropped.select(
        "doc", "version", F.floor(F.col("line") / WORD_BITS).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, line % {WORD_BITS})").alias("bit"),
    )
    return (
        placed.repartition("doc", "version")
        .groupBy("doc", "version", "word").agg(F.bit_or("bit").alias("bits"))
        .groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def _dropped_positions(words: Column) -> Column:
    def of_word(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
        held = F.filter(places, lambda b: F.getbit(w["bits"], b) == 1)
        return F.transform(held, lambda b: w["word"] * WORD_BITS + b)

    return F.flatten(F.transform(words, of_word))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Null and empty texts count as one empty line and give an empty kept text.
    Rows that repeat both id and text get the same result; rows that repeat
    only the id count as one document and lose lines each by its own text.
    A row without an id keeps all its lines.  An empty table gives an empty one.
    """
    marks = bitmaps(dropped_lines(docs, id_col, text_col, min_code_points))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    held = held.withColumn("doc", F.col("row")[id_col]).withColumn("version", text_version(F.col("row")[text_col]))
    lines = lines_of(F.col("row")[text_col])
    gone = _dropped_positions(F.col("words"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept_text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    whole = F.coalesce(F.col("row")[text_col], F.lit(""))
    return held.join(marks, ["doc", "version"], "left").select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("words").isNull(), whole).otherwise(kept_text).alias("kept_text"),
    )
