"""Deterministic pseudo-random numbers from md5: the same on every executor and every retry."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, key: Column) -> Column:
    """Text that puts rows in a fixed random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def unit(key: Column) -> Column:
    """Number in [0, 1) from the first eight hex digits of md5(key)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fold(key: Column, k: int) -> Column:
    """Group to fold number in 0..k-1; a whole group always lands in one fold."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")


#: Eight hex digits can't reach a larger draw.
POISSON_TOP = 13


def _poisson_steps(top: int) -> list[float]:
    total, out = 0.0, []
    for k in range(top):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


def poisson_bounds(top: int = POISSON_TOP) -> list[int]:
    """A Poisson(1) draw by inversion of a 32-bit number is how many of these bounds it reaches."""
    return [math.ceil(total * 4294967296.0) for total in _poisson_steps(top)]


def poisson1_sql(u: str, top: int = POISSON_TOP) -> str:
    """The same inversion of a number u as SQL text, for checks in another engine."""
    parts = [f"WHEN {u} < {total!r} THEN {k}" for k, total in enumerate(_poisson_steps(top))]
    return "CASE " + " ".join(parts) + f" ELSE {top} END"


_MD5_SINES = np.array([int(abs(math.sin(i + 1)) * 4294967296.0) for i in range(64)], np.uint32)
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_STEP = ((1, 0), (5, 1), (3, 5), (7, 0))


def md5_numbers(starts: Sequence[bytes], ends: Sequence[bytes]) -> np.ndarray:
    """md5(start + end) as four big-endian 32-bit numbers for each start, one row an end.

    All texts that fit one block of md5 are hashed side by side; longer ones one by one.
    """
    out = np.empty((len(ends), 4 * len(starts)), np.uint32)
    size = max(map(len, ends), default=0) + 1
    if max(map(len, starts), default=0) + size > 56:
        for i, end in enumerate(ends):
            out[i] = np.frombuffer(b"".join(hashlib.md5(start + end).digest() for start in starts), ">u4")
        return out
    tail = np.array([end + b"\x80" for end in ends], f"S{size}").view(np.uint8).reshape(len(ends), size)
    lengths = np.fromiter(map(len, ends), np.uint32, len(ends))
    for k, start in enumerate(starts):
        text = np.zeros((len(ends), 64), np.uint8)
        text[:, : len(start)] = np.frombuffer(start, np.uint8)
        text[:, len(start) : len(start) + size] = tail
        word = np.ascontiguousarray(text.view("<u4").astype(np.uint32).T)
        word[14] = (lengths + np.uint32(len(start))) * np.uint32(8)
        first = [np.full(len(ends), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = first
        for i in range(64):
            kind = i // 16
            if kind == 0:
                mix = d ^ (b & (c ^ d))
            elif kind == 1:
                mix = c ^ (d & (b ^ c))
            elif kind == 2:
                mix = b ^ c ^ d
            else:
                mix = c ^ (b | ~d)
            times, more = _MD5_STEP[kind]
            mix += a
            mix += word[(times * i + more) % 16]
            mix += _MD5_SINES[i]
            turn = _MD5_TURNS[kind][i % 4]
            turned = mix << np.uint32(turn)
            turned |= mix >> np.uint32(32 - turn)
            turned += b
            a, b, c, d = d, turned, b, c
        for j, (x, y) in enumerate(zip(first, (a, b, c, d))):
            out[:, 4 * k + j] = (x + y).byteswap()
    return out
