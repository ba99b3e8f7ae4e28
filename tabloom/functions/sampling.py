"""Keyed pseudo-random choices.

Every random decision is a function of (seed, operation, row key), so a plan gives the same
rows on any number of partitions and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, op: str, *keys: Column | str) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{op}"), *[c.cast("string") for c in cols]))


def unit_interval(digest_col: Column) -> Column:
    """U[0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(digest_col, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed: int, op: str, *keys: Column | str) -> Column:
    return unit_interval(digest(seed, op, *keys))


def first_half(digest_col: Column) -> Column:
    """Whether the number of a digest, see ``unit_interval``, is below a half; its first digit tells."""
    return digest_col < "8"


def pick_int(seed: int, op: str, lo: int, hi: int, *keys: Column | str) -> Column:
    """Integer in [lo, hi]."""
    return (F.lit(lo) + F.floor(uniform(seed, op, *keys) * F.lit(hi - lo + 1))).cast("int")


def pick(seed: int, op: str, values: list, *keys: Column | str) -> Column:
    """One element of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), pick_int(seed, op, 1, len(values), *keys))


def sql_digest(seed: int, op: str, *keys: str) -> str:
    return "md5(concat_ws('|', '%d', '%s', %s))" % (seed, op, ", ".join(f"CAST({k} AS VARCHAR)" for k in keys))


def sql_uniform(seed: int, op: str, *keys: str) -> str:
    return f"(CAST(('0x' || substr({sql_digest(seed, op, *keys)}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def sql_pick_int(seed: int, op: str, lo: int, hi: int, *keys: str) -> str:
    return f"CAST({lo} + floor({sql_uniform(seed, op, *keys)} * {hi - lo + 1}) AS INTEGER)"


def sql_pick(seed: int, op: str, values: list, *keys: str) -> str:
    items = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{items}])[{sql_pick_int(seed, op, 1, len(values), *keys)}]"
