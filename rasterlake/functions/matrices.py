"""3x3 matrices as flat lists of nine; works for numbers and for columns alike."""

from __future__ import annotations

# --- fixed values: D50 white (x, y) and the Bradford cone matrix --------------
D50_XY = (0.34570, 0.35850)
BRADFORD = (0.8951, 0.2664, -0.1614, -0.7502, 1.7135, 0.0367, 0.0389, -0.0685, 1.0296)


def multiply(a, b):
    return [sum_of(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def apply(m, v):
    return [sum_of(m[3 * i + k] * v[k] for k in range(3)) for i in range(3)]


def sum_of(items):
    items = list(items)
    total = items[0]
    for item in items[1:]:
        total = total + item
    return total


def invert(m):
    a, b, c, d, e, f, g, h, i = m
    adjugate = [
        e * i - f * h, c * h - b * i, b * f - c * e,
        f * g - d * i, a * i - c * g, c * d - a * f,
        d * h - e * g, b * g - a * h, a * e - b * d,
    ]
    det = a * adjugate[0] + b * adjugate[3] + c * adjugate[6]
    return [x / det for x in adjugate]


def white_xyz(xy):
    x, y = xy
    return [x / y, x / x, (1.0 - x - y) / y]


def rgb_to_xyz(r, g, b, w):
    """Linear RGB to XYZ: columns are the primaries scaled to sum to white."""
    unscaled = [r[0], g[0], b[0], r[1], g[1], b[1]] + [1.0 - p[0] - p[1] for p in (r, g, b)]
    scale = apply(invert(unscaled), white_xyz(w))
    return [unscaled[3 * i + j] * scale[j] for i in range(3) for j in range(3)]


def bradford(src_white, dst_white):
    """Chromatic adaptation between two whites given as XYZ triples."""
    src = apply(BRADFORD, src_white)
    dst = apply(BRADFORD, dst_white)
    gains = [d / s for d, s in zip(dst, src)]
    scaled = [gains[i] * BRADFORD[3 * i + j] for i in range(3) for j in range(3)]
    return multiply(invert(BRADFORD), scaled)


def colorants_d50(r, g, b, w):
    return multiply(bradford(white_xyz(w), white_xyz(D50_XY)), rgb_to_xyz(r, g, b, w))


def between(src, dst):
    """Linear matrix from one set of (r, g, b, w) chromaticities to another."""
    adapt = bradford(white_xyz(src[3]), white_xyz(dst[3]))
    return multiply(invert(rgb_to_xyz(*dst)), multiply(adapt, rgb_to_xyz(*src)))


def xy_of_columns(m):
    """Chromaticities x, y of the three columns of an RGB->XYZ matrix."""
    out = []
    for j in range(3):
        total = m[j] + m[3 + j] + m[6 + j]
        out += [m[j] / total, m[3 + j] / total]
    return out
