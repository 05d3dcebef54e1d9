"""Sets of hashed word shingles, computed for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 4
#: Bytes hashed at a time; a longer text is cut at white space, and its words put together again.
PIECE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
#: Arbitrary odd constants.
STEP = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the finish of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(LOWER + np.uint64(1))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (STEP, INVERSE))
    return _POWERS[size]


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of a piece; no word crosses a break."""
    up, down = _powers(len(data))
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[breaks[breaks < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = before[1:] & inside[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of a text longer than a piece."""
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(SPACE[data[end:end + PIECE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + PIECE, len(data))
        found.append(word_hashes(data[at:end], np.zeros(0, np.int64))[1])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def places(n: int) -> np.ndarray:
    """An odd constant for each word of a shingle."""
    more = mix(np.arange(len(PLACES), max(n, len(PLACES)), dtype=np.uint64) * STEP) | np.uint64(1)
    return np.concatenate([PLACES, more])[:n]


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Distinct shingles of one text, ascending as signed numbers; fewer words than a shingle are one."""
    if len(words) < size:
        rows = (words * places(len(words))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)) if len(words) else words
    else:
        rows = sum(words[i:len(words) - size + 1 + i] * p for i, p in enumerate(places(size)))
    out = np.sort(mix(rows).view(np.int64))
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The set of `size`-word shingles of each text of an Arrow string array; null and wordless texts have empty ones."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(offsets[at:], offsets[at] + PIECE, side="right")) - 1)
        end = min(end, len(texts))
        data = whole[offsets[at]:offsets[end]]
        if end == at + 1 and len(data) > PIECE:
            yield shingle_hashes(_long(data), size)
        else:
            bounds = offsets[at:end + 1] - offsets[at]
            starts, words = word_hashes(data, bounds[:-1])
            cuts = np.searchsorted(starts, bounds)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield shingle_hashes(words[a:b], size)
        at = end


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart: two independent sums over the members."""
    x = shingles.view(np.uint64)
    with np.errstate(over="ignore"):
        return int(mix(x ^ STEP).sum(dtype=np.uint64).view(np.int64)), int(mix(x + PLACES[0]).sum(dtype=np.uint64).view(np.int64))
