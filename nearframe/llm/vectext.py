"""Array operations over the bytes of many texts at once: words, rolling hashes, window minima.

``slice_hash`` is a polynomial and so only picks places (anchors, features) in short windows: equality of
texts is never decided by it. Words and shingles have 128-bit hashes that are mixed after every eight bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n (kept, and grown as longer buffers come)."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, BASE_INV)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                factor = np.uint64(pow(base, have, 1 << 64))
                step = min(have, size - have)
                np.multiply(out[:step], factor, out=out[have : have + step])
                have += step
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers; differences give the hash of any slice."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * power[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive keys the place of its smallest, the first one on ties."""
    n = len(key)
    if n < width:
        return np.empty(0, np.int64)
    blocks = -(-n // width)
    # rank and place in one number would need more than 64 bits: order by dense rank instead
    pad = blocks * width - n
    place = np.arange(n + pad, dtype=np.int64).reshape(blocks, width)
    top = np.append(key, np.full(pad, np.iinfo(key.dtype).max, key.dtype)).reshape(blocks, width)
    ahead = np.minimum.accumulate(top, axis=1)
    new = np.ones((blocks, width), bool)
    new[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, place, -1), axis=1)
    flipped = top[:, ::-1]
    behind = np.minimum.accumulate(flipped, axis=1)
    new[:, 1:] = flipped[:, 1:] <= behind[:, :-1]
    new[:, 0] = True
    behind_at = np.minimum.accumulate(np.where(new, place[:, ::-1], np.iinfo(np.int64).max), axis=1)[:, ::-1].reshape(-1)
    ahead_at = ahead_at.reshape(-1)
    left, right = behind_at[: n - width + 1], ahead_at[width - 1 : n]
    return np.where(key[left] <= key[right], left, right)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


#: Words of more bytes than this are hashed one by one (BLAKE2b).
LONG = 64
_SEED = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_STEP = (np.uint64(0xA4093822299F31D1), np.uint64(0x082EFA98EC4E6C89))


def _mix2(x: np.ndarray) -> np.ndarray:
    """Another bijection of the kind of ``mix``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each data[start:end], eight bytes of all words at a time."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    h1 = mix(size.astype(np.uint64) ^ _SEED[0])
    h2 = _mix2(size.astype(np.uint64) ^ _SEED[1])
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        rest = np.minimum(size[at] - k, 8).astype(np.uint64) * np.uint64(8)
        lane = lanes[start[at] + k] & (np.uint64(MASK) >> (np.uint64(64) - rest))
        h1[at] = mix((h1[at] ^ lane) + _STEP[0])
        h2[at] = _mix2((h2[at] + lane) ^ _STEP[1])
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        h1[i], h2[i] = np.frombuffer(digest, "<u8")
    return h1, h2


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct `width`-word shingles of each text as 128-bit hashes, (shingles, 2), ordered by the first half.

    Shorter texts: the whole sequence is the one shingle.
    """
    out: list[np.ndarray] = [np.empty((0, 2), np.uint64)] * len(raws)
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) < 1_000_000):
            size += len(raws[hi]) + 1
            hi += 1
        data = lower_ascii(np.frombuffer(b" ".join([*raws[lo:hi], b""]), np.uint8))
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        w1, w2 = word_hashes(data, start, end)
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws[lo:hi])])
        bound = np.searchsorted(start, offsets)
        count = max(0, len(start) - width + 1)
        r1, r2 = np.full(count, _SEED[1]), np.full(count, _SEED[0])
        for k in range(width):
            r1 = mix((r1 ^ w1[k : k + count]) + _STEP[1])
            r2 = _mix2((r2 + w2[k : k + count]) ^ _STEP[0])
        for i, (s, e) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
            if e - s >= width:
                out[lo + i] = _distinct(r1[s : e - width + 1], r2[s : e - width + 1])
            elif e > s:
                whole = b"".join([len(w).to_bytes(8, "little") + w for w in (data[a:b].tobytes() for a, b in zip(start[s:e], end[s:e], strict=True))])
                out[lo + i] = np.frombuffer(hashlib.blake2b(whole, digest_size=16).digest(), "<u8").reshape(1, 2)
        lo = hi
    return out


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.argsort(a)
    a, b = a[order], b[order]
    new = np.concatenate([[True], a[1:] != a[:-1]])
    if not new.all() and (b[1:] != b[:-1])[~new[1:]].any():  # the first halves of different shingles are equal
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return np.stack([a[new], b[new]], axis=1)
