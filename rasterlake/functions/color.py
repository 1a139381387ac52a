"""Colour arithmetic on linear or encoded RGB columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import matrices
from rasterlake.functions.chromaticities import PRIMARIES
from rasterlake.functions.curves import Curve, SDR_WHITE_NITS, clamp, from_linear, inline, named_curve, to_linear

# --- fixed values -------------------------------------------------------------
LUMA_709 = (0.2126, 0.7152, 0.0722)
LUMA_2020 = (0.2627, 0.6780, 0.0593)
M_2020_TO_709 = (
    1.6602269424, -0.5875473357, -0.0728385790,
    -0.1245536957, 1.1329258308, -0.0083491262,
    -0.0181550952, -0.1006026875, 1.1189980479,
)
LAB_XN = 0.9642
LAB_ZN = 0.8249
BAYER_4X4 = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)
HABLE = (0.15, 0.50, 0.10, 0.20, 0.02, 0.30)
REINHARD_KNEE = 0.75
MOBIUS_KNEE = 0.3
OOTF_NOMINAL_NITS = 1000.0

RGB = tuple[Column, Column, Column]


class Stages:
    """Names the steps of a long computation as columns of a DataFrame.

    A column expression that uses an earlier step twice repeats its whole tree,
    so chained steps grow exponentially and outgrow code generation. Naming the
    step keeps the plan linear; the projections still run in one fused stage.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._n = 0

    def __call__(self, name: str, value: Column) -> Column:
        self._n += 1
        full = f"__{self._n}_{name}"
        self.df = self.df.withColumn(full, value)
        return F.col(full)

    def triple(self, name: str, values) -> RGB:
        """Name three columns in a single projection."""
        self._n += 1
        names = [f"__{self._n}_{name}{c}" for c in "rgb"]
        self.df = self.df.withColumns(dict(zip(names, values)))
        return tuple(F.col(n) for n in names)


def luma(rgb: RGB, weights=LUMA_709) -> Column:
    r, g, b = rgb
    wr, wg, wb = weights
    return F.lit(wr) * r + F.lit(wg) * g + F.lit(wb) * b


def apply_matrix(rgb: RGB, m) -> RGB:
    """Linear map without clamping; m holds nine numbers or columns."""
    cells = [x if isinstance(x, Column) else F.lit(float(x)) for x in m]
    return tuple(matrices.apply(cells, rgb))


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + F.lit(16.0 / 116.0))


def lab_d50(rgb8: RGB, colorants, let=inline) -> RGB:
    """8-bit sRGB codes to CIE Lab under D50."""
    srgb = named_curve("iec61966-2-1")
    linear = tuple(let("lin", to_linear(c / 255.0, srgb)) for c in rgb8)
    x, y, z = (let("xyz", v) for v in apply_matrix(linear, colorants))
    fx, fy, fz = (let("f", v) for v in (_lab_f(x / LAB_XN), _lab_f(y / 1.0), _lab_f(z / LAB_ZN)))
    return fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0


def delta_e76(rgb_a: RGB, rgb_b: RGB, colorants, let=inline) -> Column:
    lab_a, lab_b = lab_d50(rgb_a, colorants, let), lab_d50(rgb_b, colorants, let)
    apart = [let("apart", p - q) for p, q in zip(lab_a, lab_b)]
    return F.sqrt(matrices.sum_of(d * d for d in apart))


def _triangle(src_xy, dst_xy, slack: float):
    """(all source primaries inside, target area); for numbers and columns."""

    def area(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    corners = [(dst_xy[2 * i], dst_xy[2 * i + 1]) for i in range(3)]
    inside = None
    for i in range(3):
        px, py = src_xy[2 * i], src_xy[2 * i + 1]
        sides = [area(*corners[k], *corners[(k + 1) % 3], px, py) for k in range(3)]
        low = (sides[0] <= slack) & (sides[1] <= slack) & (sides[2] <= slack)
        high = (sides[0] >= -slack) & (sides[1] >= -slack) & (sides[2] >= -slack)
        inside = (low | high) if inside is None else inside & (low | high)
    return inside, area(*corners[0], *corners[1], *corners[2])


def gamut_contains(src_xy, dst_xy, slack: float = 1e-6) -> Column:
    """Are the three source primaries inside the target triangle?

    Null when either side is unknown or the target triangle is degenerate.
    """
    inside, area = _triangle(src_xy, dst_xy, slack)
    return F.when(F.abs(area) < 1e-9, F.lit(None).cast("boolean")).otherwise(inside)


def token_contained(src: Column, dst: Column) -> Column:
    """The same question for two tokens of the fixed primaries table, answered
    by a literal map; null when either token is unknown."""
    xy = {t: matrices.xy_of_columns(matrices.colorants_d50(*p)) for t, p in PRIMARIES.items()}
    inside = {a: [b for b in xy if _triangle(xy[a], xy[b], 1e-6)[0]] for a in xy}
    table = F.create_map(*[
        c for a, bs in inside.items() for c in (F.lit(a), F.array(*[F.lit(b) for b in bs]))])
    known = dst.isin(*xy)
    return F.when(known, F.array_contains(F.try_element_at(table, src), dst))


def gamut_compress(rgb: RGB, weights, keep: float, let=inline) -> RGB:
    """Desaturate towards grey of the same luminance, then normalise by the max.

    The saturation demand seen so far carries from R to G to B, so the three
    channels are chained in that order.
    """
    y = let("y", luma(rgb, weights))
    saturation = F.lit(0.0)
    lightness = F.lit(0.0)
    for value in rgb:
        diff = let("diff", value - y)
        inverse = let("inv", F.lit(1.0) / F.when(diff == 0.0, F.lit(1.0)).otherwise(diff))
        ratio = let("ratio", value * inverse)
        saturation = let("sat", F.when(diff < 0.0, F.greatest(saturation, ratio)).otherwise(saturation))
        lightness = let("light", F.greatest(lightness, F.when(diff <= 0.0, saturation).otherwise(ratio - inverse)))
    mix = let("mix", clamp(F.lit(keep) * (saturation - lightness) + lightness, 0.0, 1.0))
    mixed = tuple(let("mixed", mix * (y - v) + v) for v in rgb)
    peak = let("peak", F.greatest(F.lit(1.0), *mixed))
    return tuple(v / peak for v in mixed)


def reinhard_segmented(y: Column, headroom: float) -> Column:
    k = REINHARD_KNEE
    if headroom <= k:
        return F.when(y <= k, y).otherwise(F.lit(1.0))
    t = (y - k) / (headroom - k)
    eased = t / (t + 1.0) * 2.0
    return F.when(y <= k, y).otherwise(clamp(clamp(eased, 0.0, 1.0) * (1.0 - k) + k, 0.0, 1.0))


def _hable_raw(x):
    a, b, c, d, e, f = HABLE
    return (x * (x * a + b * c) + d * e) / (x * (x * a + b) + d * f) - e / f


def hable(y: Column, headroom: float) -> Column:
    return F.when(y <= 0.0, F.lit(0.0)).otherwise(_hable_raw(y) / _hable_raw(headroom))


def mobius(y: Column, peak: float, knee: float = MOBIUS_KNEE) -> Column:
    den = knee * knee - 2.0 * knee + peak
    a = -knee * knee * (peak - 1.0) / (1e-12 if abs(den) < 1e-12 else den)
    b = (knee * knee - 2.0 * knee * peak + peak) / max(peak - 1.0, 1e-6)
    gain = (b * b + 2.0 * b * knee + knee * knee) / (b - a)
    return F.when(y <= knee, y).otherwise((y + a) / (y + b) * gain)


def tone_map(rgb: RGB, mode: str, peak_nits: float, dst: Curve,
             sdr_white: float = SDR_WHITE_NITS, sdr_peak: float = 100.0, let=inline) -> RGB:
    """Scale all channels by the mapped maximum; identity without headroom."""
    headroom = peak_nits / sdr_white
    if headroom <= 1.0:
        return rgb
    if mode == "bt2446a":
        return bt2446a(rgb, peak_nits, dst, sdr_white, sdr_peak, let)
    curve = {"reinhard": reinhard_segmented, "hable": hable, "mobius": mobius}[mode]
    top = let("top", F.greatest(*rgb))
    scale = let("scale", F.when(top <= 1e-6, F.lit(1.0)).otherwise(curve(top, headroom) / top))
    return tuple(v * scale for v in rgb)


def _rho(nits: float) -> float:
    return 1.0 + 32.0 * (nits / 10000.0) ** (1 / 12.4)


def bt2446a_luma(y_prime: Column, hdr_nits: float, sdr_nits: float, let=inline) -> Column:
    rho_h, rho_s = _rho(hdr_nits), _rho(sdr_nits)
    p = let("p", F.log(y_prime * (rho_h - 1.0) + 1.0) / math.log(rho_h))
    c = (
        F.when(p <= 0.7399, p * 1.0770)
        .when(p < 0.9909, p * p * -1.1510 + p * 2.7811 - 0.6302)
        .otherwise(p * 0.5 + 0.5)
    )
    return (F.pow(F.lit(rho_s), c) - 1.0) / (rho_s - 1.0)


def bt2446a(rgb: RGB, peak_nits: float, dst: Curve, sdr_white: float, sdr_peak: float, let=inline) -> RGB:
    k = sdr_white / max(1.0, peak_nits)

    def gamma(v):
        n = F.greatest(v * k, F.lit(0.0))
        return F.when(n <= 0.0, F.lit(0.0)).otherwise(F.pow(n, F.lit(1 / 12.4)))

    r, g, b = (let("gamma", gamma(v)) for v in rgb)
    y = let("y", luma((r, g, b), LUMA_2020))
    y_sdr = let("ysdr", bt2446a_luma(y, peak_nits, sdr_peak, let))
    f = let("f", F.when(y <= 0.0, F.lit(1.0)).otherwise(F.pow(y_sdr / y, F.lit(1.1))))
    cb, cr = let("cb", f * (b - y) / 1.8814), let("cr", f * (r - y) / 1.4746)
    y_out = let("yout", y_sdr - F.greatest(cr * 0.1, F.lit(0.0)))
    ro, bo = let("ro", y_out + cr * 1.4746), let("bo", y_out + cb * 1.8814)
    go = let("go", (y_out - ro * 0.2627 - bo * 0.0593) / 0.6780)
    return tuple(to_linear(let("sdr", clamp(v, 0.0, 1.0)), dst) for v in (ro, go, bo))


def sdr_to_hdr_nits(y_prime: Column) -> Column:
    y = y_prime * 255.0
    exponent = F.when(y <= 70.0, y * y * 1.8712e-5 - y * 2.7334e-3 + 1.3141).otherwise(
        y * y * 2.8305e-6 - y * 7.4622e-4 + 1.2528
    )
    return F.when(y <= 0.0, F.lit(0.0)).otherwise(F.pow(y, exponent))


def system_gamma(peak_nits: float) -> float:
    return 1.2 if peak_nits <= 0 else 1.2 + 0.42 * math.log10(peak_nits / OOTF_NOMINAL_NITS)


def _signed_pow(x: Column, p: float) -> Column:
    return F.when(x >= 0.0, F.pow(x, F.lit(p))).otherwise(-F.pow(-x, F.lit(p)))


def _ootf_scale(ys: Column, gamma: float, alpha: float) -> Column:
    at_zero = 0.0 if gamma > 1.0 else alpha if gamma == 1.0 else float("inf")
    return F.when(ys == 0.0, F.lit(at_zero)).otherwise(_signed_pow(ys, gamma - 1.0) * alpha)


def ootf(rgb: RGB, peak_nits: float, let=inline) -> RGB:
    """Scene light to display light in nits."""
    peak = peak_nits if peak_nits > 0 else OOTF_NOMINAL_NITS
    k = let("k", _ootf_scale(let("ys", luma(rgb, LUMA_2020)), system_gamma(peak), peak))
    return tuple(v * k for v in rgb)


def ootf_inverse(rgb: RGB, peak_nits: float, let=inline) -> RGB:
    """Display light in nits back to scene light; black stays black."""
    peak = peak_nits if peak_nits > 0 else OOTF_NOMINAL_NITS
    gamma = system_gamma(peak)
    yd = let("yd", luma(rgb, LUMA_2020) / peak)
    ys = let("ys", _signed_pow(yd, 1.0 / gamma))
    scale = let("scale", _ootf_scale(ys, gamma, peak))
    inverse = let("inv", F.when(scale == 0.0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), scale)))
    return tuple(v * inverse for v in rgb)


def dither_offset(x: Column, y: Column) -> Column:
    """Ordered 4x4 offset in code units, centred on zero."""
    table = F.array(*[F.lit(v / 16.0) for v in BAYER_4X4])
    index = x.bitwiseAND(3) + F.shiftleft(y.bitwiseAND(3), 2)
    return F.element_at(table, (index + 1).cast("int")) - 7.5 / 16.0


def quantize8(code16: Column, offset: Column | float = 0.0) -> Column:
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    value = code16 / 65535.0 * 255.0 + offset
    return clamp(F.floor(value + 0.5), 0, 255).cast("int")


def encode16(linear: Column, curve: Curve, let=inline) -> Column:
    return clamp(F.floor(clamp(from_linear(linear, curve, let), 0.0, 1.0) * 65535.0 + 0.5), 0, 65535).cast("int")
