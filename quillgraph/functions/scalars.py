"""Scalar functions: hash-based uniforms and normals, the Gaussian-mechanism constant, thresholds."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(seed: int, *key: str | Column) -> Column:
    """A uniform number in (0, 1) that depends on the seed and key only, alike in any engine with md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


_MD5_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]


def u01_range(prefix: str, count: int) -> np.ndarray:
    """u01() of the keys prefix + "1" .. prefix + str(count), where `prefix` holds the seed and the key before, each with its colon: md5 of all keys of equal length at once."""
    head, out, low = np.frombuffer(prefix.encode(), np.uint8), np.empty(count), 1
    while low <= count:
        digits = len(str(low))
        high = min(count + 1, 10**digits)
        size = len(head) + digits
        if size > 55:
            raise ValueError("a key of more than 55 bytes")
        block = np.zeros((high - low, 64), np.uint8)
        block[:, : len(head)] = head
        block[:, len(head) : size] = np.arange(low, high)[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + 48
        block[:, size] = 0x80
        block[:, 56:58] = size * 8 & 0xFF, size * 8 >> 8
        word = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = start = tuple(np.full(high - low, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f = f + a + word[g] + np.uint32(_MD5_SINES[i])
            a, b, c, d = d, b + (f << np.uint32(_MD5_SHIFTS[i]) | f >> np.uint32(32 - _MD5_SHIFTS[i])), b, c
        out[low - 1 : high - 1] = ((a + start[0]).byteswap().astype(np.float64) + 0.5) / 4294967296.0
        low = high
    return out


def normal(seed: int, *key: str | Column) -> Column:
    """A standard normal draw from two hash uniforms (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(u01(seed, *key))) * F.cos(2.0 * math.pi * u01(seed + 1, *key))


def gaussian_constant(eps: float, delta: float, precision: float = 1e-12) -> float:
    """The constant K by which noise scales for (eps, delta): bisection on differences of two normal distribution functions.
    A formula of this engine's data model; no privacy guarantee is claimed for it."""
    phi, root = NormalDist().cdf, math.sqrt(eps)
    wide = delta >= phi(0.0) - math.exp(eps) * phi(-math.sqrt(2 * eps))
    side = 1.0 if wide else -1.0

    def above(x: float) -> bool:
        value = phi(side * root * x) - math.exp(eps) * phi(-root * (x + 2))
        return value >= delta if wide else value <= delta

    high = 1.0
    while not above(high):
        high *= 2
    low = 0.0
    while high - low > precision * max(1.0, high):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return math.sqrt(1 + high / 2) - side * math.sqrt(high / 2)


def activation_threshold(rho: float = 0.1) -> float:
    """The upper rho / 2 quantile of the standard normal; 1.645 by default."""
    return NormalDist().inv_cdf(1 - rho / 2)


def log_bound(blocks: int, delta: float, sensitivity: float) -> float:
    return math.log((blocks + blocks**2) / delta) * sensitivity


def clean_name(name: str) -> str:
    """File-safe name: colons, dots and commas become underscores."""
    return name.translate(str.maketrans(":.,", "___"))


def fit_folder(name: str, parameters: dict) -> str:
    return clean_name("_".join([name, *(f"{k}_{v}" for k, v in sorted(parameters.items()))]))
