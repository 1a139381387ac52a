"""Transfer curves: encoded code values to linear light and back."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: seven-parameter curves (g, a, b, c, d, e, f) ---------------
PARAMETRIC = {
    "iec61966-2-1": (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045, 0.0, 0.0),
    "bt709": (1 / 0.45, 1 / 1.099, 0.099 / 1.099, 1 / 4.5, 0.08125, 0.0, 0.0),
    "smpte170m": (1 / 0.45, 1 / 1.099, 0.099 / 1.099, 1 / 4.5, 0.08125, 0.0, 0.0),
    "smpte240m": (1 / 0.45, 1 / 1.1115, 0.1115 / 1.1115, 1 / 4.0, 0.0912, 0.0, 0.0),
    "bt470m": (2.2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "bt470bg": (2.8, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "prophoto": (1.8, 1.0, 0.0, 1 / 16, 16 / 512, 0.0, 0.0),
    "gamma18": (1.8, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "gamma26": (2.6, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}
# --- fixed values: PQ and HLG ------------------------------------------------
PQ_M1 = 2610 / 16384
PQ_M2 = 2523 / 4096 * 128
PQ_C1 = 3424 / 4096
PQ_C2 = 2413 / 4096 * 32
PQ_C3 = 2392 / 4096 * 32
HLG_A = 0.17883277
HLG_B = 0.28466892
HLG_C = 0.55991073
PQ_PEAK_NITS = 10000.0
SDR_WHITE_NITS = 203.0


@dataclass(frozen=True)
class Curve:
    """kind is parametric, linear, pq, hlg or table; one literal kind per plan
    lets Catalyst fold the unused branches away before code generation."""

    kind: str
    params: tuple = ()
    lut: Column | None = None


def named_curve(token: str) -> Curve:
    if token == "linear":
        return Curve("linear")
    if token == "smpte2084":
        return Curve("pq")
    if token == "arib-std-b67":
        return Curve("hlg")
    return Curve("parametric", PARAMETRIC[token])


def table_curve(values) -> Curve:
    return Curve("table", lut=F.array(*[F.lit(float(v)) for v in values]))


def clamp(x: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(x, low), high)


def inline(name: str, value: Column) -> Column:
    """Use a step's expression in place; color.Stages names it instead."""
    return value


def to_linear(x: Column, curve: Curve, let=inline) -> Column:
    if curve.kind == "linear":
        return x
    if curve.kind == "pq":
        return pq_to_linear(x, let)
    if curve.kind == "hlg":
        return hlg_to_linear(x)
    if curve.kind == "table":
        return lookup_lut(x, curve.lut)
    g, a, b, c, d, e, f = curve.params
    sign, mag = F.signum(x), F.abs(x)
    inner = F.lit(a) * mag + F.lit(b)
    return (
        F.when(mag < d, sign * (F.lit(c) * mag + F.lit(f)))
        .when(inner <= 0.0, sign * F.lit(e))
        .otherwise(sign * (F.pow(inner, F.lit(g)) + F.lit(e)))
    )


def from_linear(x: Column, curve: Curve, let=inline) -> Column:
    if curve.kind == "linear":
        return x
    if curve.kind == "pq":
        return linear_to_pq(x, let)
    if curve.kind == "hlg":
        return linear_to_hlg(x)
    if curve.kind == "table":
        return invert_lut(x, curve.lut)
    g, a, b, c, d, e, f = curve.params
    sign, mag = F.signum(x), F.abs(x)
    body = sign * ((F.pow(F.greatest(mag - F.lit(e), F.lit(0.0)), F.lit(1.0 / g)) - F.lit(b)) / F.lit(a))
    if c == 0.0 or d <= 0.0:
        return body
    return F.when(mag < c * d + f, sign * ((mag - F.lit(f)) / F.lit(c))).otherwise(body)


def pq_to_linear(x: Column, let=inline) -> Column:
    p = let("p", F.pow(x, F.lit(1.0 / PQ_M2)))
    den = F.lit(PQ_C2) - F.lit(PQ_C3) * p
    num = F.greatest(p - F.lit(PQ_C1), F.lit(0.0))
    return F.when((x <= 0.0) | (den <= 0.0), F.lit(0.0)).otherwise(F.pow(num / den, F.lit(1.0 / PQ_M1)))


def linear_to_pq(x: Column, let=inline) -> Column:
    y = let("pqy", F.pow(x, F.lit(PQ_M1)))
    ratio = (F.lit(PQ_C1) + F.lit(PQ_C2) * y) / (F.lit(1.0) + F.lit(PQ_C3) * y)
    return F.when(x <= 0.0, F.lit(0.0)).otherwise(F.pow(ratio, F.lit(PQ_M2)))


def linear_value(x: float, curve: Curve) -> float:
    """One encoded value in [0, 1] to linear light, outside Spark."""
    if curve.kind == "linear":
        return x
    if curve.kind == "pq":
        p = x ** (1.0 / PQ_M2)
        return 0.0 if x <= 0.0 else (max(p - PQ_C1, 0.0) / (PQ_C2 - PQ_C3 * p)) ** (1.0 / PQ_M1)
    if curve.kind == "hlg":
        return x * x / 3.0 if x <= 0.5 else (math.exp((x - HLG_C) / HLG_A) + HLG_B) / 12.0
    g, a, b, c, d, e, f = curve.params
    return c * x + f if x < d else (a * x + b) ** g + e


def decode_codes(code: Column, curve: Curve, top: int = 255) -> Column:
    """Whole codes 0..top to linear light by a constant table of that size.

    The table is a folded literal, so a pixel costs one array read instead of
    a power.
    """
    table = ", ".join(f"{linear_value(i / top, curve)!r}D" for i in range(top + 1))
    return F.element_at(F.expr(f"array({table})"), code.cast("int") + 1)


def hlg_to_linear(x: Column) -> Column:
    return F.when(x <= 0.5, x * x / 3.0).otherwise(
        (F.exp((x - F.lit(HLG_C)) / F.lit(HLG_A)) + F.lit(HLG_B)) / 12.0
    )


def linear_to_hlg(x: Column) -> Column:
    low = F.sqrt(F.greatest(x * 3.0, F.lit(0.0)))
    high = F.lit(HLG_A) * F.log(F.greatest(x * 12.0 - F.lit(HLG_B), F.lit(1e-12))) + F.lit(HLG_C)
    return F.when(x <= 1.0 / 12.0, low).otherwise(high)


def lookup_lut(x: Column, lut: Column) -> Column:
    """Clamp to [0, 1], then interpolate between neighbouring entries."""
    last = F.size(lut) - 1
    u = clamp(x, 0.0, 1.0) * last
    i = F.floor(u).cast("int")
    low = F.element_at(lut, i + 1)
    high = F.element_at(lut, F.least(i + 2, last + 1))
    return F.when(i >= last, F.element_at(lut, -1)).otherwise(low + (high - low) * (u - i))


def invert_lut(x: Column, lut: Column) -> Column:
    """Position in [0, 1] of a linear value in a rising table."""
    last = F.size(lut) - 1
    i = F.greatest(F.size(F.filter(lut, lambda v: v <= x)) - 1, F.lit(0))
    low = F.element_at(lut, i + 1)
    high = F.element_at(lut, F.least(i + 2, last + 1))
    span = high - low
    frac = F.when(span <= 0.0, F.lit(0.0)).otherwise((x - low) / span)
    return (
        F.when(x <= F.element_at(lut, 1), F.lit(0.0))
        .when(x >= F.element_at(lut, -1), F.lit(1.0))
        .otherwise((i + frac) / last)
    )
