"""Reproducible per-row pseudo-random numbers.

A value depends only on (key, seed), never on partitioning or task order, so
a rerun or a recomputed partition after a lost executor gives the same rows.
Integer keys use two rounds of a 31-bit linear congruential step written in
plain integer arithmetic (the same expression runs in any SQL engine); other
keys use ``xxhash64``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# Fixed values of the 31-bit linear congruential step.
LCG_MULT = 1103515245
LCG_INC = 12345
MOD31 = 2147483648
KEY_MOD = 2147483647


def _lcg(x: Column) -> Column:
    return F.pmod(x * F.lit(LCG_MULT) + F.lit(LCG_INC), F.lit(MOD31))


def unit_hash(col: Column, seed: int, integral: bool = True) -> Column:
    """A number in [0, 1) determined by (col, seed)."""
    if integral:
        h = _lcg(_lcg(F.pmod(col.cast("bigint"), F.lit(KEY_MOD)) + F.lit(seed)))
        return h.cast("double") / float(MOD31)
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)


def unit_hash_of(df, key: str, seed: int) -> Column:
    return unit_hash(F.col(key), seed, isinstance(df.schema[key].dataType, IntegralType))


def unit_hash_sql(key: str, seed: int) -> str:
    """The same number in SQL, for integer keys."""
    inner = f"(({key} % {KEY_MOD}) + {seed})"
    h1 = f"(({inner} * {LCG_MULT} + {LCG_INC}) % {MOD31})"
    h2 = f"(({h1} * {LCG_MULT} + {LCG_INC}) % {MOD31})"
    return f"(cast({h2} as double) / {MOD31}.0)"


def unit_md5(col: Column, seed: int, name: str) -> Column:
    """A number in [0, 1) from 52 bits of an md5 of (seed, name, col): numbers under
    different names are independent of one another."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), col.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def unit_md5_sql(key: str, seed: int, name: str) -> str:
    """The same number in SQL."""
    return f"(cast(('0x' || substr(md5('{seed}:{name}:' || {key}), 1, 13)) as bigint) / {float(1 << 52)!r})"
