"""The multiplicative congruential generator of bootstraps, with jumps: draw k of a seed is seed * A**k modulo 2**32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator.
A, M = 1664525, 2**32


def _times(x: Column, y: Column | int) -> Column:
    """x * y modulo 2**32 without overflowing 64 bits: y in halves of 16 bits."""
    y = y if isinstance(y, Column) else F.lit(y)
    high, low = F.shiftright(y, 16), y.bitwiseAND(0xFFFF)
    return ((x * high) % M * 65536 + x * low) % M


def state(seed: Column | int, k: Column) -> Column:
    """The generator's state after k draws from the seed (k below 2**32)."""
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    out = seed
    for byte in range(4):  # digits of k in base 256, each with its own table of powers
        step = pow(A, 256**byte, M)
        table = F.array(*[F.lit(pow(step, j, M)).cast("long") for j in range(256)])
        digit = F.shiftright(k.cast("long"), 8 * byte).bitwiseAND(255).cast("int")
        out = _times(out, F.element_at(table, digit + 1))
    return out


def uniform(seed: Column | int, k: Column) -> Column:
    """Draw k (from 1) of the seed, in [0, 1)."""
    return state(seed, k) / F.lit(float(M))
