"""Tokens of sections of documents, counted by where each token's characters lie.

A document is encoded once, as a whole, so its tokens are those that a model
sees; encoding each section by itself would give others.  The lengths of the
tokens in bytes give every token's span in the document.  Sections are spans
too, so both are intervals in order, and joining them is one sorted search per
document.

The rule for a token that crosses a border: it counts for the section that
holds most of its characters, of equal parts for the first.  A character that
several tokens share counts for the token that begins it.  A token without a
character of its own goes with the character that it continues.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_held: dict[tuple[str, str], tuple] = {}


def byte_tokenizer(path: str, pattern: str) -> tuple:
    """The encoding of a file of ranks, and the bytes that each token stands for; one for each worker process."""
    if (path, pattern) not in _held:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _held[path, pattern] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size)
    return _held[path, pattern]


def token_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each token, given the text's bytes and the tokens' lengths in bytes.

    A character belongs to the token that holds its first byte.
    """
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
    ends = np.cumsum(sizes)
    return begun[ends - sizes], begun[ends]


def attribute(first: np.ndarray, after: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, -1 for none, and whether the token crosses a border.

    Sections are spans of characters in order that do not overlap; they may leave gaps.
    """
    if not len(starts):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    begin = np.where(after > first, first, np.maximum(first - 1, 0))  # a token within a character goes with that
    end = np.maximum(after, begin + 1)
    lo = np.searchsorted(ends, begin, "right")  # first section that ends behind the token's start
    hi = np.searchsorted(starts, end, "left") - 1  # last that starts before the token's end
    held = np.minimum(lo, len(starts) - 1)
    one = np.minimum(end, ends[held]) - np.maximum(begin, starts[held])
    best, most = np.where(one > 0, lo, -1), np.maximum(one, 0)
    for k in np.flatnonzero(hi > lo):  # tokens that touch several sections
        for s in range(lo[k] + 1, hi[k] + 1):
            part = min(end[k], ends[s]) - max(begin[k], starts[s])
            if part > most[k]:
                best[k], most[k] = s, part
    return best, (best >= 0) & (most < end - begin)


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines, each with the line feed that ends it; an empty text is one empty line."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    return np.concatenate([[0], breaks]), np.concatenate([breaks, [len(text)]])


def _counts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = byte_tokenizer(path, pattern)
        for batch in batches:
            texts, given = batch.column(1), batch.column(2)
            for lo in range(0, batch.num_rows, 512):
                rows, sections, starts, ends, tokens, crossing = [], [], [], [], [], []
                for i in range(lo, min(lo + 512, batch.num_rows)):
                    text = texts[i].as_py() or ""
                    ids = np.array(encoding.encode_ordinary(text), np.int64)
                    if given[i].is_valid:
                        spans = given[i].values
                        s, e = pc.struct_field(spans, 0).cast(pa.int64()), pc.struct_field(spans, 1).cast(pa.int64())
                    else:
                        s, e = map(pa.array, line_spans(text))
                    whole = np.flatnonzero(pc.and_(s.is_valid(), e.is_valid()).to_numpy(zero_copy_only=False))
                    first, after = token_spans(np.frombuffer(text.encode(), np.uint8), size[ids])
                    at, cross = attribute(first, after, *(x.take(pa.array(whole)).to_numpy() for x in (s, e)))
                    rows.append(np.full(len(s), i))
                    sections.append(np.arange(len(s)))
                    starts.append(s)
                    ends.append(e)
                    for held, counts in ((at >= 0, tokens), (cross, crossing)):
                        n = np.zeros(len(s), np.int64)
                        n[whole] = np.bincount(at[held], minlength=len(whole))
                        counts.append(n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sections).astype(np.int64)),
                    pa.concat_arrays(starts), pa.concat_arrays(ends), *(pa.array(np.concatenate(v).astype(np.int64)) for v in (tokens, crossing)),
                ], names=["doc", "section", "start", "end", "n_tokens", "n_crossing"])

    return run


def section_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """``(doc, section, start, end, n_tokens, n_crossing)``: one row for each section of each row of ``docs``.

    ``spans_col`` names an array of structs of two integers, the first
    character of a section and the one after its last, in order and without
    overlap; without it, and where it is null, the sections are the lines.
    A section of which a bound is null holds no token and keeps its null.
    ``n_crossing`` counts those of a section's tokens that reach into another
    or into a gap.  A null text counts as empty, which is one line without
    tokens.  Rows that repeat an id are counted each.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    kind = docs.schema[id_col].dataType.simpleString()
    spans = F.col(spans_col) if spans_col else F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), spans.alias("spans"))
    return rows.mapInArrow(
        _counts(path or ranks_path(), pattern), f"doc {kind}, section long, start long, end long, n_tokens long, n_crossing long")
