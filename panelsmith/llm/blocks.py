"""Blocks of rows inside a task: rows that were placed and sorted by a key come out together, whatever the batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("key", "i", "j")) -> Iterator[pa.Table]:
    """The complete blocks of equal keys of rows that come sorted by them; a block may span batches."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = pa.Table.from_batches([batch])
        block = np.stack([now[c].to_numpy() for c in keys])
        starts = np.flatnonzero(np.concatenate([[True], (block[:, 1:] != block[:, :-1]).any(axis=0)]))
        for lo, hi in zip(starts, [*starts[1:], now.num_rows]):
            key = tuple(block[:, lo])
            if held and key != held_key:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(now.slice(lo, hi - lo))
            held_key = key
    if held:
        yield pa.concat_tables(held).combine_chunks()
