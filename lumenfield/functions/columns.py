"""Column expressions of the scoring protocol."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the quality mask.
LOW_SNR, POOR_PSF_FIT, CROWDED, BRIGHT_CORE, RESIDUAL_DEBLEND, CLASSIFIER_UNCERTAIN = 1, 2, 4, 8, 16, 32


def number(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def r6(x: Column) -> Column:
    """Six decimals, as results are compared."""
    return F.round(x, 6)


def square(x: Column) -> Column:
    return x * x


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 7."""
    y = z + 7.0
    y3 = y * y * y
    series = 1 / (12 * y) - 1 / (360 * y3) + 1 / (1260 * y3 * y * y) - 1 / (1680 * y3 * y3 * y)
    below = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def wilson_low(k: Column, n: Column, z: float = 1.96, *, clip: bool = True) -> Column:
    return _wilson(k, n, z, -1.0, clip)


def wilson_high(k: Column, n: Column, z: float = 1.96, *, clip: bool = True) -> Column:
    return _wilson(k, n, z, 1.0, clip)


def _wilson(k: Column, n: Column, z: float, sign: float, clip: bool) -> Column:
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    mid = (p + z * z / (2.0 * n)) / (1.0 + z * z / n)
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / (1.0 + z * z / n)
    bound = mid + sign * half
    if clip:
        bound = F.greatest(bound, F.lit(0.0)) if sign < 0 else F.least(bound, F.lit(1.0))
    return F.when(n > 0, bound)


def ratio(k: Column, n: Column) -> Column:
    """k / n with a denominator of at least one."""
    return k.cast("double") / F.greatest(n, F.lit(1)).cast("double")


def instrumental_mag(flux: Column, floor: float = 1e-6) -> Column:
    return F.lit(-2.5) * F.log10(F.greatest(flux, F.lit(floor)))


def flux_of(mag: Column, zero_point: float) -> Column:
    return F.pow(F.lit(10.0), F.lit(-0.4) * (mag - zero_point))


def source_snr(flux: Column, rms: Column | float, area: float = 9.0 * math.pi) -> Column:
    return flux / F.sqrt(F.greatest(flux, F.lit(0.0)) + area * square(number(rms)) + 1e-12)


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def checkerboard(x: Column, y: Column, size: float = 200.0) -> Column:
    return F.pmod(cell(x, size) + cell(y, size), F.lit(3))


def stripes(x: Column, size: float = 200.0) -> Column:
    return F.pmod(cell(x, size), F.lit(3))


def skewed_cells(x: Column, y: Column, size: float = 200.0) -> Column:
    return F.pmod(cell(x, size) + 2 * cell(y, size), F.lit(3))


def tile_id(x: Column, y: Column, size: float = 200.0, across: int = 6) -> Column:
    """Row-major tile of a square grid; places outside go to the edge tiles."""
    clip = lambda c: F.least(F.greatest(cell(c, size), F.lit(0)), F.lit(across - 1))
    return clip(y) * across + clip(x)


def tile_role(tile: Column) -> Column:
    h = F.pmod(tile * 17 + 11, F.lit(5))
    return F.when(h <= 2, "train").when(h == 3, "validation").otherwise("test")


def magnitude_bin(mag: Column) -> Column:
    """(lo, hi] bins; null and NaN have none."""
    return F.when(mag.isNull() | F.isnan(mag), None).when(mag <= 18, "V<=18").when(mag <= 20, "18<V<=20").when(mag <= 21, "20<V<=21").when(mag <= 22, "21<V<=22").otherwise("V>22")


def density_bin(n: Column) -> Column:
    """[lo, hi] bins of a neighbour count."""
    return F.when(n.isNull(), None).when(n <= 1, "0-1 neighbours").when(n == 2, "2 neighbours").otherwise(">=3 neighbours")


def snr_bin(snr: Column) -> Column:
    """[lo, hi) bins."""
    return F.when(snr.isNull() | F.isnan(snr), None).when(snr < 5, "SNR<5").when(snr < 10, "5<=SNR<10").when(snr < 20, "10<=SNR<20").when(snr < 50, "20<=SNR<50").otherwise("SNR>=50")


def scene_magnitude_bin(mag: Column) -> Column:
    return F.when(mag <= 25, "<=25").when(mag <= 27, "25-27").otherwise(">27")


def scene_density_bin(n: Column) -> Column:
    return F.when(n <= 1, "0-1").when(n <= 4, "2-4").otherwise(">=5")


def quality_bitmask(snr: Column, fit: Column, neighbours: Column, bright_core: Column, deblend: Column, probability: Column) -> Column:
    """Six flags in one integer.  Null and NaN set no bit."""
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    bit = lambda c, b: F.when(F.coalesce(c, F.lit(False)), b).otherwise(0)
    return (
        bit(known(snr) & (snr < 5), LOW_SNR)
        + bit(known(fit) & (fit > 3), POOR_PSF_FIT)
        + bit(neighbours >= 3, CROWDED)
        + bit(bright_core, BRIGHT_CORE)
        + bit(deblend, RESIDUAL_DEBLEND)
        + bit(known(probability) & (probability > 0.2) & (probability < 0.8), CLASSIFIER_UNCERTAIN)
    ).cast("int")


def inside(x: Column, y: Column, size: float = 1200.0, margin: float = 12.0) -> Column:
    return (x >= margin) & (x < size - margin) & (y >= margin) & (y < size - margin)


def measured(mag: Column) -> Column:
    return mag < 90


def good_quality(mag: Column, err: Column, qfit: Column, oth: Column, nv: Column) -> Column:
    return measured(mag) & (err < 0.10) & (qfit < 0.30) & (oth < 1.0) & (nv >= 1)


def calibration_quality(mag: Column, err: Column, qfit: Column, oth: Column, nv: Column) -> Column:
    return good_quality(mag, err, qfit, oth, nv) & (mag <= 21) & (err < 0.05) & (qfit < 0.15) & (oth < 0.10)
