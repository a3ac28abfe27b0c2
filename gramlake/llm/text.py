"""Words, hashes and shingle sets of whole texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A batch of texts is worked on in pieces of about so many bytes, to bound a worker's memory.
PIECE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; x is uint64 and is not changed."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pieces(texts: list[bytes | None]) -> list[slice]:
    """Slices of texts with about PIECE_BYTES each; a longer text stands alone."""
    return _cuts([len(t or b"") for t in texts])


def _cuts(sizes: list[int], most: int | None = None) -> list[slice]:
    out, start, held = [], 0, 0
    most = most or PIECE_BYTES
    for i, n in enumerate(sizes):
        if held and held + n > most:
            out.append(slice(start, i))
            start, held = i, 0
        held += n
    if start < len(sizes):
        out.append(slice(start, len(sizes)))
    return out


def text_pieces(column: pa.Array, most: int | None = None) -> Iterator[tuple[slice, list[bytes | None]]]:
    """The pieces of a column of texts, one after the other as bytes: no more than one is held beside the column. most: about
    so many bytes each, PIECE_BYTES where it is not given."""
    for p in _cuts(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield p, as_bytes(column.slice(p.start, p.stop - p.start))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` of a text in UTF-8; only A-Z are lower-cased. Null and empty texts have none."""
    return (text.lower() if lower else text).split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """The hash of each word (of bytes without whitespace), as `hashed` gives it."""
    return hashed([b" ".join(tokens)], lower=False)[0]


#: Bytes of text in a step, and of a word that is hashed by powers; longer words are each hashed by xxHash.
STEP, LONGEST = 1 << 16, 1 << 14
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(STEP + LONGEST, _BASE, np.uint64))
_INVERSE = np.cumprod(np.full(STEP + LONGEST, pow(_BASE, -1, 1 << 64), np.uint64))


def hashed(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in a row, bounds): text k has hashes[bounds[k] : bounds[k + 1]].

    The words are those of `words`. A hash is a polynomial of the word's scrambled bytes modulo 2^64, and its length,
    mixed: the bytes of a step are multiplied by running powers at once, and a word's sum by the inverse power of its start.
    """
    joined = b"\n".join([t or b"" for t in texts]) + b"\n"
    raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate([[0], edge])
    starts = edge[::2]
    size = edge[1::2] - starts
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + STEP))
        at = edge[2 * lo : 2 * hi] - starts[lo]
        at = np.minimum(at, at[-2] + LONGEST)  # the last word's end
        v = raw[starts[lo] : starts[lo] + at[-1]].astype(np.uint64)
        v += np.uint64(1)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(29)
        v *= _POWERS[: len(v)]
        sums = np.add.reduceat(np.append(v, np.uint64(0)), at)[::2]
        out[lo:hi] = sums * _INVERSE[at[::2]]
        lo = hi
    out = mix(out + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for k in np.flatnonzero(size > LONGEST):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + size[k]].tobytes())
    at = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)])
    return out, np.searchsorted(starts, at)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of width words, in order."""
    n = len(h) - width + 1
    acc = h[:n].copy()
    for k in range(1, width):
        acc = mix(acc) + h[k : n + k]
    return mix(acc)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words are one shingle, none have none."""
    if not len(h):
        return h
    # a short text's only shingle must not equal a shingle of full width
    return np.unique(windows(h, width)) if len(h) >= width else mix(windows(h, len(h)) + np.uint64(len(h)))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The shingles of each text."""
    h, at = hashed(texts)
    return [shingles(h[a:b], width) for a, b in zip(at, at[1:], strict=False)]


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]
