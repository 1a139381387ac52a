"""Curves, matrices and colour arithmetic: anchors and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import color, curves, gain, matrices, media, text
from rasterlake.functions.chromaticities import PRIMARIES
from rasterlake.operators import colorspace


@pytest.fixture(scope="module")
def ramp(spark):
    return spark.range(0, 257).select((F.col("id") / 256.0).alias("v"))


@pytest.mark.parametrize("token", [*curves.PARAMETRIC, "linear", "smpte2084", "arib-std-b67"])
def test_round_trip(ramp, token):
    c = curves.named_curve(token)
    back = curves.from_linear(curves.to_linear(F.col("v"), c), c)
    # The toe of these three meets the power segment only approximately.
    limit = 2e-3 if token in ("bt709", "smpte170m", "smpte240m") else 1e-6
    assert ramp.select(F.max(F.abs(back - F.col("v")))).first()[0] < limit


def test_table_round_trip(ramp):
    c = curves.table_curve([0.0, 0.02, 0.1, 0.3, 0.65, 1.0])
    back = curves.from_linear(curves.to_linear(F.col("v"), c), c)
    assert ramp.select(F.max(F.abs(back - F.col("v")))).first()[0] < 1e-9


@pytest.mark.parametrize("token", [*curves.PARAMETRIC, "linear", "smpte2084", "arib-std-b67"])
def test_decode_table_equals_the_curve(spark, token):
    c = curves.named_curve(token)
    off = F.abs(curves.decode_codes(F.col("id"), c) - curves.to_linear(F.col("id") / 255.0, c))
    assert spark.range(256).select(F.max(off)).first()[0] < 1e-12


def test_negative_light_is_mirrored(spark):
    c = curves.named_curve("iec61966-2-1")
    row = spark.range(1).select(curves.to_linear(F.lit(-0.5), c).alias("n"), curves.to_linear(F.lit(0.5), c).alias("p")).first()
    assert row.n == -row.p


def test_pq_anchor(spark):
    row = spark.range(1).select(
        curves.linear_to_pq(F.lit(1.0)).alias("one"), curves.linear_to_pq(F.lit(0.01)).alias("hundred_nits"),
        curves.hlg_to_linear(F.lit(0.5)).alias("hlg")).first()
    assert row.one == pytest.approx(1.0)
    assert row.hundred_nits == pytest.approx(0.508, abs=1e-3)
    assert row.hlg == pytest.approx(1 / 12)


@pytest.mark.parametrize("token", list(PRIMARIES))
def test_matrices(token):
    m = matrices.rgb_to_xyz(*PRIMARIES[token])
    white = matrices.apply(m, [1.0, 1.0, 1.0])
    assert white == pytest.approx(matrices.white_xyz(PRIMARIES[token][3]))
    assert matrices.multiply(m, matrices.invert(m)) == pytest.approx(list(np.eye(3).ravel()), abs=1e-12)
    assert [sum(matrices.between(PRIMARIES[token], PRIMARIES["bt2020"])[3 * i:3 * i + 3]) for i in range(3)] == pytest.approx([1, 1, 1])


def test_known_709_matrix():
    assert matrices.rgb_to_xyz(*PRIMARIES["bt709"])[:3] == pytest.approx([0.4124, 0.3576, 0.1805], abs=1e-4)


def test_gamut_contains(spark):
    df = spark.createDataFrame([("bt709", "bt2020"), ("bt2020", "bt709"), ("p3", "bt709"), ("srgb", "display-p3"), ("what", "bt709")], "a string, b string")
    got = [r.contained for r in colorspace.gamut_relation(df, "a", "b").collect()]
    assert got == [True, False, False, True, None]
    by_token = df.select(color.token_contained(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in by_token][:2] == [True, False]


def test_tone_map_is_identity_without_headroom(spark):
    rgb = (F.lit(0.9), F.lit(0.5), F.lit(0.1))
    assert color.tone_map(rgb, "hable", 203.0, curves.named_curve("bt709")) is rgb
    for mode in ("reinhard", "hable", "mobius", "bt2446a"):
        out = color.tone_map((F.lit(4.926),) * 3, mode, 1000.0, curves.named_curve("linear"))
        assert spark.range(1).select(out[0]).first()[0] == pytest.approx(1.0, abs=0.02)


def test_gamut_compress_stays_inside(spark):
    rgb = (F.lit(1.3), F.lit(-0.2), F.lit(0.4))
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(color.gamut_compress(rgb, color.LUMA_709, 1.0), "rgb")]).first()
    assert all(-1e-9 <= v <= 1.0 for v in row)


def test_black_survives_ootf(spark):
    zero = (F.lit(0.0),) * 3
    row = spark.range(1).select(color.ootf_inverse(color.ootf(zero, 1000.0), 1000.0)[0].alias("v")).first()
    assert row.v == 0.0


def test_transform_identity(spark):
    px = spark.range(256).select(F.lit(0).alias("x"), F.lit(0).alias("y"), *[F.col("id").cast("int").alias(c) for c in "rgb"])
    srgb = curves.named_curve("iec61966-2-1")
    out = colorspace.transform_pixels(px, colorspace.Transform(srgb, srgb)).collect()
    assert [r.r for r in out] == list(range(256))


def test_scene_referred_chain_round_trips(spark):
    px = spark.range(1, 256).select(F.lit(0).alias("x"), F.lit(0).alias("y"), *[F.col("id").cast("int").alias(c) for c in "rgb"])
    hlg = curves.named_curve("arib-std-b67")
    plan = colorspace.Transform(hlg, hlg, src_scene_peak=1000.0, dst_scene_peak=1000.0, gamut_keep=1.0)
    assert [r.g for r in colorspace.transform_pixels(px, plan).collect()] == list(range(1, 256))


def test_dither_mean_is_zero(spark):
    px = spark.range(16).select((F.col("id") % 4).cast("int").alias("x"), F.floor(F.col("id") / 4).cast("int").alias("y"))
    assert px.select(F.sum(color.dither_offset(F.col("x"), F.col("y")))).first()[0] == 0.0


def test_gain_edges(spark):
    row = spark.range(1).select(
        gain.log2_gain(F.lit(1.0), F.lit(-1.0)).alias("den"), gain.log2_gain(F.lit(-1.0), F.lit(1.0), False).alias("ratio"),
        gain.gain_to_byte(F.lit(9.0), F.lit(3.0), F.lit(0.0)).alias("top")).first()
    assert (row.den, row.ratio, row.top) == (0.0, -100.0, 255)


@pytest.mark.parametrize("fmt,q,want", [("jpg", 50, 16.0), ("png", 50, 4.0), ("jpegli", 99, 0.2), ("avif", 50, 32.0), ("jxl", 100, 0.0), ("jxl", 90, 1.0)])
def test_quality_to_setting(spark, fmt, q, want):
    assert spark.range(1).select(media.quality_to_setting(F.lit(fmt), F.lit(q))).first()[0] == want


@pytest.mark.parametrize("name,want", [("yuvj420p", 8), ("yuv444p12le", 12), ("rgb48be", 16), ("rgba64le", 16), ("rgba", 8), ("gray", 8),
                                       ("gray10le", 10), ("ya16le", 16), ("gbrpf32le", 32), ("rgbaf16le", 16), ("p010le", 10), ("xyz12le", 12), ("odd", 0), (None, 0)])
def test_bit_depth(spark, name, want):
    assert spark.createDataFrame([(name,)], "p string").select(media.bit_depth(F.col("p"))).first()[0] == want


def test_text_edges(spark):
    row = spark.range(1).select(
        text.format_duration(F.lit(0.4)).alias("a"), text.format_duration(F.lit(3.25)).alias("b"),
        media.rational(F.lit("1/0")).alias("c"), media.rational(F.lit("x")).alias("d"),
        text.under_prefix(F.lit("/a/bc/d"), F.lit("/a/b")).alias("e"), text.guess_space(F.lit("none")).alias("f")).first()
    assert tuple(row) == ("<1s", "3.3s", 0.0, 0.0, False, None)


def test_psnr_of_identical_is_infinite(spark):
    from rasterlake.operators import quality
    px = spark.range(10).selectExpr("1 asset_id", "0 frame", "0 y", "cast(id as int) x", "cast(id as int) code")
    assert math.isinf(quality.psnr(px, px).first().psnr)


def test_named_spaces_are_recognised(spark):
    cells = [f"m{i}" for i in range(9)]
    rows = [(name, *(float(v) + 1e-3 * (-1) ** i for i, v in enumerate(m))) for name, m in colorspace.known_spaces()]
    rows.append(("none", *([0.3] * 9)))
    got = colorspace.nearest_known_space(spark.createDataFrame(rows, "name string, " + ", ".join(f"{c} double" for c in cells)), cells)
    assert {r["name"]: r["space"] for r in got.collect()} == {name: name for name, _ in colorspace.known_spaces()} | {"none": None}
