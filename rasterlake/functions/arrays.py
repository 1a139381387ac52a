"""The curves and colour steps of `curves` and `color` over numpy arrays, for kernels over buffers.

Decoding is one read of a table with an entry per code. Encoding inverts the curve
once: a rising curve with a last code of `top` is `top` thresholds, and a value's code is
the number of thresholds it reaches. A table over the fourth root of the value, in
which every curve is smooth, gives a code just below, and a few comparisons with the
thresholds settle it. So no power is taken per sample, and the code is that of the formula.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from rasterlake.functions import color
from rasterlake.functions.curves import (
    HLG_A, HLG_B, HLG_C, PQ_C1, PQ_C2, PQ_C3, PQ_M1, PQ_M2, SDR_WHITE_NITS, Curve, linear_value,
)

RGB = tuple[np.ndarray, np.ndarray, np.ndarray]


@lru_cache(64)
def _decode_table(kind: str, params: tuple, top: int) -> np.ndarray:
    curve = Curve(kind, params)
    return np.array([linear_value(i / top, curve) for i in range(top + 1)])


def decode_table(curve: Curve, top: int) -> np.ndarray:
    """Linear light of the codes 0..top."""
    _known(curve)
    return _decode_table(curve.kind, curve.params, top)


def _known(curve: Curve) -> None:
    if curve.kind == "table":
        raise ValueError("a kernel needs a curve by formula")


def to_linear(x: np.ndarray, curve: Curve) -> np.ndarray:
    """Encoded values of 0 or more to linear light."""
    _known(curve)
    if curve.kind == "linear":
        return x
    if curve.kind == "pq":
        p = x ** (1.0 / PQ_M2)
        return (np.maximum(p - PQ_C1, 0.0) / (PQ_C2 - PQ_C3 * p)) ** (1.0 / PQ_M1)
    if curve.kind == "hlg":
        return np.where(x <= 0.5, x * x / 3.0, (np.exp((x - HLG_C) / HLG_A) + HLG_B) / 12.0)
    g, a, b, c, d, e, f = curve.params
    return np.where(x < d, c * x + f, np.maximum(a * x + b, 0.0) ** g + e)


def from_linear(x: np.ndarray, curve: Curve) -> np.ndarray:
    """Linear light of 0 or more to encoded values."""
    _known(curve)
    if curve.kind == "linear":
        return x
    if curve.kind == "pq":
        y = x**PQ_M1
        return np.where(x <= 0.0, 0.0, ((PQ_C1 + PQ_C2 * y) / (1.0 + PQ_C3 * y)) ** PQ_M2)
    if curve.kind == "hlg":
        return np.where(x <= 1.0 / 12.0, np.sqrt(x * 3.0), HLG_A * np.log(np.maximum(x * 12.0 - HLG_B, 1e-12)) + HLG_C)
    g, a, b, c, d, e, f = curve.params
    body = (np.maximum(x - e, 0.0) ** (1.0 / g) - b) / a
    return body if c == 0.0 or d <= 0.0 else np.where(x < c * d + f, (x - f) / c, body)


def _code(encoded: np.ndarray, bits: int) -> np.ndarray:
    """The formula: 16-bit codes are rounded, 8-bit codes are taken from them."""
    wide = np.floor(np.clip(encoded, 0.0, 1.0) * 65535.0 + 0.5)
    return wide if bits == 16 else np.floor(wide / 65535.0 * 255.0 + 0.5)


class Encoder:
    """Codes of 8 or 16 bits of linear values; values outside [0, 1] are clamped."""

    def __init__(self, curve: Curve, bits: int) -> None:
        codes = np.arange(1, 2**bits)
        # The least value of each code, by bisection over the bits of the number: these rise as it does.
        one = np.float64(1.0).view(np.int64)
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), one + 1)
        while (low < high).any():
            middle = (low + high) // 2
            reached = _code(from_linear(middle.view(np.float64), curve), bits) >= codes
            low, high = np.where(reached, low, middle + 1), np.where(reached, middle, high)
        at = np.where(high > one, np.inf, high.view(np.float64))
        self.buckets = 1 << (18 if bits == 16 else 16)
        edges = (np.arange(self.buckets + 1) / self.buckets) ** 4
        first = np.searchsorted(at, edges * (1.0 - 1e-12), side="right")
        last = np.searchsorted(at, edges * (1.0 + 1e-12), side="right")
        self.steps = int((last[1:] - first[:-1]).max())
        self.base = first[:-1].astype(np.int32)
        self.at = np.append(at, np.inf)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        v = np.clip(v, 0.0, 1.0)
        place = np.minimum((np.sqrt(np.sqrt(v)) * self.buckets).astype(np.int32), self.buckets - 1)
        code = self.base[place]
        for _ in range(min(self.steps, 4)):
            code = code + (self.at[code] <= v)
        # A curve with a step has a bucket of many codes; the few values in it are looked up one by one.
        left = np.flatnonzero(self.at[code] <= v) if self.steps > 4 else ()
        if len(left):
            code[left] = np.searchsorted(self.at, v[left], side="right")
        return code


@lru_cache(64)
def _encoder(kind: str, params: tuple, bits: int) -> Encoder:
    return Encoder(Curve(kind, params), bits)


def encoder(curve: Curve, bits: int) -> Encoder:
    _known(curve)
    return _encoder(curve.kind, curve.params, bits)


def luma(rgb: RGB, weights) -> np.ndarray:
    return weights[0] * rgb[0] + weights[1] * rgb[1] + weights[2] * rgb[2]


def apply_matrix(rgb: RGB, m) -> RGB:
    r, g, b = rgb
    return tuple(m[3 * i] * r + m[3 * i + 1] * g + m[3 * i + 2] * b for i in range(3))


def gamut_compress(rgb: RGB, weights, keep: float) -> RGB:
    """As color.gamut_compress."""
    y = luma(rgb, weights)
    saturation = lightness = np.zeros_like(y)
    for value in rgb:
        diff = value - y
        inverse = 1.0 / np.where(diff == 0.0, 1.0, diff)
        ratio = value * inverse
        saturation = np.where(diff < 0.0, np.maximum(saturation, ratio), saturation)
        lightness = np.maximum(lightness, np.where(diff <= 0.0, saturation, ratio - inverse))
    mix = np.clip(keep * (saturation - lightness) + lightness, 0.0, 1.0)
    mixed = tuple(mix * (y - v) + v for v in rgb)
    peak = np.maximum(1.0, np.maximum(np.maximum(mixed[0], mixed[1]), mixed[2]))
    return tuple(v / peak for v in mixed)


def _reinhard(y: np.ndarray, headroom: float) -> np.ndarray:
    k = color.REINHARD_KNEE
    if headroom <= k:
        return np.where(y <= k, y, 1.0)
    t = (y - k) / (headroom - k)
    return np.where(y <= k, y, np.clip(np.clip(t / (t + 1.0) * 2.0, 0.0, 1.0) * (1.0 - k) + k, 0.0, 1.0))


def _hable(y: np.ndarray, headroom: float) -> np.ndarray:
    return np.where(y <= 0.0, 0.0, color._hable_raw(y) / color._hable_raw(headroom))


def _mobius(y: np.ndarray, peak: float) -> np.ndarray:
    knee = color.MOBIUS_KNEE
    den = knee * knee - 2.0 * knee + peak
    a = -knee * knee * (peak - 1.0) / (1e-12 if abs(den) < 1e-12 else den)
    b = (knee * knee - 2.0 * knee * peak + peak) / max(peak - 1.0, 1e-6)
    return np.where(y <= knee, y, (y + a) / (y + b) * ((b * b + 2.0 * b * knee + knee * knee) / (b - a)))


def tone_map(rgb: RGB, mode: str, peak_nits: float, dst: Curve, sdr_white: float = SDR_WHITE_NITS, sdr_peak: float = 100.0) -> RGB:
    """As color.tone_map."""
    headroom = peak_nits / sdr_white
    if headroom <= 1.0:
        return rgb
    if mode == "bt2446a":
        return _bt2446a(rgb, peak_nits, dst, sdr_white, sdr_peak)
    curve = {"reinhard": _reinhard, "hable": _hable, "mobius": _mobius}[mode]
    top = np.maximum(np.maximum(rgb[0], rgb[1]), rgb[2])
    dark = top <= 1e-6
    scale = np.where(dark, 1.0, curve(top, headroom) / np.where(dark, 1.0, top))
    return tuple(v * scale for v in rgb)


def _bt2446a(rgb: RGB, peak_nits: float, dst: Curve, sdr_white: float, sdr_peak: float) -> RGB:
    k = sdr_white / max(1.0, peak_nits)
    r, g, b = (np.maximum(v * k, 0.0) ** (1 / 12.4) for v in rgb)
    y = luma((r, g, b), color.LUMA_2020)
    rho_h, rho_s = color._rho(peak_nits), color._rho(sdr_peak)
    p = np.log(y * (rho_h - 1.0) + 1.0) / math.log(rho_h)
    c = np.where(p <= 0.7399, p * 1.0770, np.where(p < 0.9909, p * p * -1.1510 + p * 2.7811 - 0.6302, p * 0.5 + 0.5))
    y_sdr = (rho_s**c - 1.0) / (rho_s - 1.0)
    f = np.where(y <= 0.0, 1.0, np.maximum(y_sdr, 0.0) / np.where(y <= 0.0, 1.0, y)) ** 1.1
    cb, cr = f * (b - y) / 1.8814, f * (r - y) / 1.4746
    y_out = y_sdr - np.maximum(cr * 0.1, 0.0)
    ro, bo = y_out + cr * 1.4746, y_out + cb * 1.8814
    go = (y_out - ro * 0.2627 - bo * 0.0593) / 0.6780
    return tuple(to_linear(np.clip(v, 0.0, 1.0), dst) for v in (ro, go, bo))


def _signed_pow(x: np.ndarray, p: float) -> np.ndarray:
    return np.sign(x) * np.abs(x) ** p


def _ootf_scale(ys: np.ndarray, gamma: float, alpha: float) -> np.ndarray:
    at_zero = 0.0 if gamma > 1.0 else alpha if gamma == 1.0 else math.inf
    zero = ys == 0.0
    return np.where(zero, at_zero, _signed_pow(np.where(zero, 1.0, ys), gamma - 1.0) * alpha)


def ootf(rgb: RGB, peak_nits: float) -> RGB:
    """As color.ootf."""
    peak = peak_nits if peak_nits > 0 else color.OOTF_NOMINAL_NITS
    k = _ootf_scale(luma(rgb, color.LUMA_2020), color.system_gamma(peak), peak)
    return tuple(v * k for v in rgb)


def ootf_inverse(rgb: RGB, peak_nits: float) -> RGB:
    """As color.ootf_inverse."""
    peak = peak_nits if peak_nits > 0 else color.OOTF_NOMINAL_NITS
    gamma = color.system_gamma(peak)
    scale = _ootf_scale(_signed_pow(luma(rgb, color.LUMA_2020) / peak, 1.0 / gamma), gamma, peak)
    inverse = np.where(scale == 0.0, 0.0, 1.0 / np.where(scale == 0.0, 1.0, scale))
    return tuple(v * inverse for v in rgb)
