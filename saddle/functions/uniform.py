"""One reproducible uniform: the leading 52 bits of an md5 over the keys.

``rand(seed)`` changes with the partitioning; this does not, and any SQL engine can repeat it.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 52)


def _parts(seed: str | int | Column, keys: tuple) -> list[Column]:
    return [seed if isinstance(seed, Column) else F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]


def uniform(seed: str | int | Column, *keys: str | Column) -> Column:
    """A double in [0, 1) from ``seed`` and the string forms of ``keys``."""
    digest = F.substring(F.md5(F.concat_ws("|", *_parts(seed, keys))), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(SCALE)


#: Bins that are told apart by comparing digests; more are counted from the number.
COMPARED = 16


def uniform_bin(n: int, seed: str | int | Column, *keys: str | Column) -> Column:
    """``floor(uniform(seed, *keys) * n)``, without making a number of the digest where the bins are few."""
    if n > COMPARED:
        return F.floor(uniform(seed, *keys) * n)
    digest = F.md5(F.concat_ws("|", *_parts(seed, keys)))
    return reduce(lambda a, b: a + b, [(digest >= F.lit(first)).cast("bigint") for first in _firsts(n)], F.lit(0).cast("bigint"))


def _firsts(n: int) -> list[str]:
    """The least leading digits of a digest in each bin but bin 0; products round as in ``uniform * n``."""
    found = []
    for k in range(1, n):
        at = -(-(k << 52) // n)
        while at and math.floor((at - 1) / SCALE * n) >= k:
            at -= 1
        found.append(format(at, "013x"))
    return found


def uniform_sql(seed: str | int, *keys: str) -> str:
    """The same value as DuckDB SQL text."""
    joined = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0)"
