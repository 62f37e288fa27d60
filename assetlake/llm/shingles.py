"""Word-shingle sets of whole texts as sorted 64-bit hashes, computed for many texts at once.

Texts are read in segments; a word may reach over any number of them. Of a very long text only the hashes of its words
and shingles are held whole, eight bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: A fixed random number per byte; A-Z have those of a-z.
_BYTES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]

#: Bytes, or shingles, worked on at once.
SEGMENT = 1 << 21

_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        found = _powers[base] = np.multiply.accumulate(found)
    return found[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_R)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end in ``data``, and each text's first word."""
    found, first, count = [], np.zeros(len(bounds), np.int64), 0
    total = np.zeros(1, np.uint64)
    # Sum and inverse power at the start of a word that has not ended yet.
    open_sums = open_inverse = np.zeros(0, np.uint64)
    for lo in range(0, len(data), SEGMENT):
        hi = min(lo + SEGMENT, len(data))
        near = ~_SEPARATORS[data[max(lo - 1, 0) : hi + 1]]
        visible = near[lo > 0 :][: hi - lo]
        edge = np.zeros(hi - lo + 1, bool)
        a, b = np.searchsorted(bounds, lo), np.searchsorted(bounds, hi, "right")
        edge[bounds[a:b] - lo] = True
        before = np.concatenate([near[:1] & (lo > 0), visible[:-1]]) & ~edge[:-1]
        after = np.concatenate([visible[1:], near[-1:] & (hi < len(data))]) & ~edge[1:]
        starts = np.flatnonzero(visible & ~before)
        ends = np.flatnonzero(visible & ~after) + 1
        scale, back = (np.uint64(pow(base, lo, 1 << 64)) for base in (_R, _R_INVERSE))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * _powers_of(_R, hi - lo), out=sums[1:])
        sums = sums * scale + total
        open_sums = np.concatenate([open_sums, sums[starts]])
        open_inverse = np.concatenate([open_inverse, _powers_of(_R_INVERSE, hi - lo)[starts] * back])
        n = len(ends)
        found.append(mixed((sums[ends] - open_sums[:n]) * open_inverse[:n]))
        first[a:b] = count + np.searchsorted(starts, bounds[a:b] - lo)
        open_sums, open_inverse, count, total = open_sums[n:], open_inverse[n:], count + len(starts), sums[-1:]
    return np.concatenate([np.zeros(0, np.uint64), *found]), first


def _folded(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` words."""
    out = np.full(len(words) - n + 1, n, np.uint64)
    for lo in range(0, len(out), SEGMENT):
        h = out[lo : lo + SEGMENT]
        for j in range(n):
            h[:] = mixed(h * _FOLD + words[lo + j : lo + j + len(h)])
    return out


def sets_of(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes (int64) of its windows of ``width`` words; of a text with fewer words,
    the whole sequence as one; of one without words, none."""
    words, first = word_hashes(data, bounds)
    windows = _folded(words, width) if len(words) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            found = windows[a : b - width + 1]
        elif b > a:
            found = _folded(words[a:b], b - a)
        else:
            found = words[:0]
        found = np.sort(found.view(np.int64))
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
    return out


def text_slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of a string column, cut at rows so that slices stay small; a longer
    single text is a slice of its own. Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
