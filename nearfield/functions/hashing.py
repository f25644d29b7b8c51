"""Hashes for routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SHARDS = (1 << 31) - 1


def sha256_mod(key: Column, n: int) -> Column:
    """The SHA-256 digest of a text, as one 256-bit number, modulo ``n``: digits of 32 bits folded by Horner's rule."""
    if not 1 <= n <= MAX_SHARDS:
        raise ValueError(f"n must be from 1 to {MAX_SHARDS}")
    digest = F.sha2(key.cast("string"), 256)
    digits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, x: F.pmod(acc * F.lit(1 << 32) + x, F.lit(n).cast("bigint"))).cast("int")


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
