"""Keyed hashes: every random draw is a pure function of (seed, purpose, id)."""
from pyspark.sql import Column, functions as F


def keyed(*parts) -> Column:
    """sha256 hex of the parts joined by ':'. Python values become literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)


def keyed_md5(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hex_int(h: Column, start: int, width: int) -> Column:
    """`width` (<= 15) hex digits of `h` from 1-based `start`, as BIGINT."""
    return F.conv(F.substring(h, start, width), 16, 10).cast("bigint")


def unit_interval(h: Column) -> Column:
    """First 64 bits of a hex digest as a double in [0, 1)."""
    n = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return n / F.lit(float(2**64))


def unit32(h: Column, start: int = 1) -> Column:
    """Eight hex digits of a digest as a double in [0, 1)."""
    return hex_int(h, start, 8).cast("double") / F.lit(float(2**32))


def assign_split(group: Column, seed: int, fractions) -> Column:
    """train/calib/test from the group id alone, cut at the cumulative fractions."""
    total = sum(f for _, f in fractions)
    if abs(total - 1.0) > 1e-9 or any(f < 0 for _, f in fractions):
        raise ValueError(f"fractions must be non-negative and sum to 1, got {fractions}")
    u, edge, out = unit_interval(keyed(seed, group)), 0.0, None
    for name, frac in fractions:
        edge += frac
        cond = u < F.lit(edge)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(fractions[-1][0])
