"""Words, window hashes and texts as numpy arrays, for use inside Arrow functions.

Words are maximal runs of bytes other than ASCII white space. A window of words is named by a 64-bit
rolling hash; two independent seeds give a 128-bit name where a name decides a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LETTER = np.arange(256, dtype=np.uint8)
_LOWER = _LETTER.copy()
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(
            np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U) for b in (base, inverse)
        )
        if size <= 1 << 21:
            _POWERS[base] = have
    return have


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every span, independent of where the span lies."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _block_words(data: np.ndarray, base: int) -> np.ndarray:
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return mix(_spans(data.astype(U) + U(1), starts, ends, base) ^ (ends - starts).astype(U))


def word_hashes(text: bytes, lower: bool = False, seed: int = 0, block: int = 1 << 20) -> np.ndarray:
    """One hash per word. Long texts are cut into blocks at white space, so memory stays near the block size."""
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = _LOWER[data]
    parts, at = [], 0
    while at < len(data):
        end = at + block
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + block]])
            if len(gap):
                end += int(gap[0])
                break
            end += block
        parts.append(_block_words(data[at:end], SEEDS[seed] | 1))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, U)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every window of ``k`` consecutive words, in order of their starts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    starts = np.arange(n)
    return mix(_spans(words, starts, starts + k, SEEDS[1 - seed] | 1) + U(k))


def span_hash(words: np.ndarray, start: int, end: int, seed: int = 0) -> int:
    """Hash of one span of words as a signed 64-bit number."""
    part = words[start:end]
    value = mix(_spans(part, np.zeros(1, int), np.array([len(part)]), SEEDS[1 - seed] | 1) + U(len(part)))
    return int(value.view(np.int64)[0])


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``k`` words; fewer words are one window, none are none."""
    if not len(words):
        return np.zeros(0, U)
    return np.unique(window_hashes(words, min(k, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Bytes of an Arrow string column without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        if not len(sizes):
            continue
        group = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for at, end in zip(cuts, cuts[1:]):
            yield batch.slice(at, end - at)
