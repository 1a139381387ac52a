"""Gain-map arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlake.functions.curves import clamp, named_curve, to_linear

# --- fixed value: offset added on both sides of the ratio ---------------------
GAIN_OFFSET = 1 / 64


def log2_gain(hdr: Column, sdr: Column, floor_at_one: bool = True,
              offset_hdr: float = GAIN_OFFSET, offset_sdr: float = GAIN_OFFSET) -> Column:
    den = sdr + offset_sdr
    ratio = F.try_divide(hdr + offset_hdr, den)
    if floor_at_one:
        value = F.log2(F.greatest(ratio, F.lit(1.0)))
    else:
        value = F.when(ratio > 0.0, F.log2(ratio)).otherwise(F.lit(-100.0))
    return F.when(den <= 0.0, F.lit(0.0)).otherwise(value)


def gain_to_byte(log_gain: Column, high: Column, low: Column) -> Column:
    """Affine to 0..255, truncated; no span means no gain to carry."""
    top = F.when((low == 0.0) & (high <= 0.0), F.lit(1.0)).otherwise(high)
    span = top - low
    value = F.floor(F.try_divide(clamp(log_gain, low, top) - low, span) * 255.0)
    return F.when(span <= 0.0, F.lit(0)).otherwise(value).cast("int")


def apply_gain(base: Column, gain: Column, low: Column, high: Column, gamma: Column,
               offset_sdr: float = GAIN_OFFSET, offset_hdr: float = GAIN_OFFSET) -> Column:
    g = F.when((gamma != 1.0) & (gamma > 0.0), F.pow(gain, F.lit(1.0) / gamma)).otherwise(gain)
    boost = low * (F.lit(1.0) - g) + high * g
    return (base + offset_sdr) * F.pow(F.lit(2.0), boost) - offset_hdr


def rec709_inverse(v: Column) -> Column:
    x = clamp(v, 0.0, 1.0)
    return F.when(x < 0.081, x / 4.5).otherwise(F.pow((x + 0.099) / 1.099, F.lit(1 / 0.45)))


def apply_gain_headroom(base: Column, gain: Column, headroom: Column) -> Column:
    return base * (F.lit(1.0) + (headroom - 1.0) * rec709_inverse(gain))


def base_from_bytes(code: Column) -> Column:
    """Linear light as a decoder will see it: from the delivered 8-bit code."""
    return to_linear(code / 255.0, named_curve("iec61966-2-1"))
