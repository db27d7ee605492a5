"""Hashes of words and of word windows, for a whole block of texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_M, _K, _K2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums S and powers P: the polynomial of values[a:b] is (S[b] - S[a]) * P[b]."""
    n = len(values) + 1
    up, down = _powers(base, 1 << max(12, (n - 1).bit_length()))
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * down[: n - 1], out=sums[1:])
    return sums, up


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes that are not white space (space, 9 to 13)."""
    solid = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums, up = _sums(data.astype(np.uint64) + _U(1), _M)
    return starts, ends, mix((sums[ends] - sums[starts]) * up[ends])


def windows(hashes: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """The hash of each run of `length` neighbours; empty if there are fewer. `second`: another hash of the same, to make 128 bits of both."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    sums, up = _sums(mix(hashes ^ _U(_K)) if second else hashes, _K2 if second else _K)
    ends = np.arange(length, len(hashes) + 1)
    return mix((sums[ends] - sums[: len(ends)]) * up[ends] + _U(length))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` neighbours, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        done += step
    return out


def joined(texts: pa.Array, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, each mapped by `fold` and followed by a space; where each begins, with the end last."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    begin = ends - ends[0] + np.arange(n + 1)
    data = np.full(begin[-1], 0x20, np.uint8)
    if ends[-1] > ends[0]:
        solid = np.ones(len(data), bool)
        solid[begin[1:] - 1] = False
        data[solid] = fold[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    return data, begin
