"""Range asymmetric numeral systems over a fixed frequency table, many lanes at once in numpy.

The state of a lane is a 64-bit number that holds what has been encoded so far;
32-bit words leave it when it grows too large.  Ids are dealt to the lanes of a
segment in turn.  Segments begin from the same state and so do not depend on
each other: any of them can be decoded from its checkpoint, that is its lanes'
states and the place of its first word.  All segments of a block are coded
together, step by step, which makes the arrays long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

LANES = 256
STEPS = 256  # of a segment
SEGMENT = LANES * STEPS  # ids between two checkpoints
SEGMENTS = 4  # of a block
BLOCK = SEGMENT * SEGMENTS
SCALE = 20  # frequencies add up to 2 ** SCALE
MOST_SCALE = 26
LOW = np.uint64(1 << 31)  # states stay between this and this times 2 ** 32
WORD = np.uint64(32)


@dataclass(frozen=True)
class Frequencies:
    """Ids in order with frequencies that add up to ``2 ** scale``, each at least 1."""

    ids: np.ndarray
    freq: np.ndarray
    scale: int

    @cached_property
    def before(self) -> np.ndarray:
        return (np.cumsum(self.freq) - self.freq).astype(np.uint64)

    @cached_property
    def symbol_of(self) -> np.ndarray:
        """The place in ``ids`` for every slot."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))

    @cached_property
    def place_of(self) -> np.ndarray:
        """The place in ``ids`` for every id."""
        out = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, np.int64)
        out[self.ids] = np.arange(len(self.ids))
        return out


def frequencies(ids: np.ndarray, counts: np.ndarray) -> Frequencies:
    """Scale counts of distinct ids, in ascending order, to a power of two; ties do not depend on their order of arrival."""
    scale = max(SCALE, max(1, len(ids)).bit_length() + 4)
    if scale > MOST_SCALE:
        raise ValueError(f"{len(ids)} different ids are more than a table of frequencies holds")
    total, room = int(counts.sum()), 1 << scale
    freq = np.array([max(1, int(c) * room // total) for c in counts], np.int64)
    over = int(freq.sum()) - room
    for k in np.argsort(-freq, kind="stable"):  # rounding is made up for by the commonest
        if over == 0:
            break
        step = min(over, int(freq[k]) // 2) if over > 0 else over
        freq[k] -= step
        over -= step
    return Frequencies(ids.astype(np.uint32), freq.astype(np.uint64), scale)


def encode(ids: np.ndarray, table: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the place of each segment's first word, and each segment's states for at most ``BLOCK`` ids."""
    n = len(ids)
    segments = max(1, -(-n // SEGMENT))
    symbols = np.zeros(segments * SEGMENT, np.int64)
    symbols[:n] = table.place_of[ids]
    symbols = symbols.reshape(segments, STEPS, LANES)
    freq, before = table.freq[symbols], table.before[symbols]
    state = np.full((segments, LANES), LOW)
    flat = state.reshape(-1)
    scale, step_limit = np.uint64(table.scale), (LOW >> np.uint64(table.scale)) << WORD
    limit, rest = step_limit * freq, (np.uint64(1) << scale) - freq
    out, sizes = [], np.zeros((segments, STEPS), np.int64)
    whole = n == segments * SEGMENT
    inside = None if whole else (np.arange(segments * SEGMENT) < n).reshape(segments, STEPS, LANES)
    for t in range(STEPS - 1, -1, -1):
        full = state >= limit[:, t]
        if not whole:
            full &= inside[:, t]
        at = np.flatnonzero(full)
        held = flat[at]
        out.append(held.astype("<u4"))
        sizes[:, t] = np.bincount(at // LANES, minlength=segments)
        flat[at] = held >> WORD
        # The quotient by the frequency moves up, the remainder stays: q * 2 ** scale + (x - q * f) + before.
        x = state // freq[:, t]
        x *= rest[:, t]
        x += before[:, t]
        if not whole:
            x *= inside[:, t]
        state += x
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    # Words lie step by step, segments side by side; put each segment's together.
    owner = np.repeat(np.tile(np.arange(segments), STEPS), sizes.T.ravel())
    return words[np.argsort(owner, kind="stable")], np.cumsum(sizes.sum(axis=1)) - sizes.sum(axis=1), state


def decode(words: np.ndarray, starts: np.ndarray, states: np.ndarray, n: int, table: Frequencies) -> np.ndarray:
    """The ``n`` ids of the given segments; all but the last are full."""
    segments = len(starts)
    state, at = states.copy(), starts.astype(np.int64).copy()
    words = np.append(words, np.zeros(1, words.dtype))
    out = np.empty((segments, STEPS, LANES), np.uint32)
    whole = n == segments * SEGMENT
    inside = None if whole else (np.arange(segments * SEGMENT) < n).reshape(segments, STEPS, LANES)
    mask, scale = np.uint64((1 << table.scale) - 1), np.uint64(table.scale)
    for t in range(STEPS):
        slot = state & mask
        s = table.symbol_of.take(slot.view(np.int64))
        out[:, t] = s
        s = s.astype(np.intp)
        x = state >> scale
        x *= table.freq.take(s)
        x += slot
        x -= table.before.take(s)
        low = x < LOW
        if not whole:
            live = inside[:, t]
            if not live.any():
                break
            low &= live
            x = np.where(live, x, state)
        flat = x.reshape(-1)
        short = np.flatnonzero(low)
        taken = np.bincount(short // LANES, minlength=segments)
        place = np.repeat(at - np.cumsum(taken) + taken, taken) + np.arange(len(short))
        flat[short] = (flat[short] << WORD) | words[place]
        at += taken
        state = x
    return table.ids[out.reshape(-1)[:n]]
