"""Numeric functions: schedules, losses, parameter counts and the portable MinHash family."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_cosine(step: Column, total: int, peak: float, warmup_fraction: float, floor: float) -> Column:
    warm = max(1, int(total * warmup_fraction))
    progress = F.least(F.lit(1.0), (step - warm) / F.lit(max(1, total - warm - 1)))
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * progress))))


def rewarm_cosine(step: Column, total: int, initial: float, peak: float, warm: int, floor: float) -> Column:
    progress = F.least(F.lit(1.0), (step - warm) / F.lit(max(1, total - warm - 1)))
    return F.when(step < warm, initial + (peak - initial) * (step / F.lit(max(1, warm - 1)))).otherwise(
        peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * progress)))
    )


def warmup_stable_decay(step: Column, peak: float, warm: int, floor: float, decay_start: int | None, decay_steps: int) -> Column:
    before = F.when(step < warm, peak * (step + 1) / warm)
    if decay_start is None:
        return before.otherwise(F.lit(peak))
    progress = F.least(F.lit(1.0), (step - decay_start + 1) / F.lit(max(1, decay_steps)))
    return before.when(step < decay_start, F.lit(peak)).otherwise(peak * (1 - (1 - floor) * progress))


def warmup_linear(step: Column, total: int, peak: float, warm: int) -> Column:
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * F.greatest(F.lit(0.0), 1 - (step - warm + 1) / F.lit(max(1, total - warm))))


def perplexity(nll: Column) -> Column:
    """exp where it is finite, else null."""
    return F.when(nll < 709, F.exp(nll))


def bits_per_byte(nll: Column, size: Column) -> Column:
    return nll / math.log(2) / size


def safe_nll(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """Whether a metric is a finite number within its range."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    if least is not None:
        good = good & (value >= least)
    if most is not None:
        good = good & (value <= most)
    return F.coalesce(good, F.lit(False))


# ------------------------------------------------------------------- MinHash

# Modulus, components, bands, and the seed of the exact family's permutations.
MERSENNE = (1 << 61) - 1
LOW = (1 << 32) - 1
COMPONENTS = 32
BANDS = 8
SEED = 424242
ROWS = COMPONENTS // BANDS


def permutation(i: int) -> tuple[int, int]:
    """Odd multiplier and offset of the portable family, below 2**31: with a 32-bit hash all fits a signed long."""
    return ((2 * i + 1) * 0x9E3779B1 % (1 << 31)) | 1, (i + 1) * 0x85EBCA6B % (1 << 31)


def shingle_hash(shingle: Column) -> Column:
    """32 bits of MD5, the same in Spark and in SQL engines."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("long")


def permuted(h: Column, i: int) -> Column:
    """((a * h + b) mod 2**61 - 1) mod 2**32, in generated code on longs."""
    a, b = permutation(i)
    return ((F.lit(a).cast("long") * h + F.lit(b).cast("long")) % F.lit(MERSENNE)).bitwiseAND(F.lit(LOW))
