"""Histograms and gain maps over tiles against the long form and direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import gainmap, gaintiles, measure, tiles
from test_tiles import cut, whole

RNG = np.random.default_rng(21)


def pixels_of(spark, images, names):
    rows = [(a, y, x, *map(float, px[y, x])) for (a, _), px in images.items() for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "asset_id long, y int, x int, " + ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("held", [64 << 20, 1])
def test_gamut_fit_reads_once_and_agrees(spark, monkeypatch, held):
    monkeypatch.setattr(gaintiles, "HELD_BYTES", held)
    inside = RNG.integers(20_000, 30_000, (12, 10, 1)).repeat(3, 2)
    images = {(1, 0): RNG.integers(0, 65536, (23, 17, 3)), (2, 0): inside, (3, 0): np.zeros((4, 5, 3), int), (4, 0): RNG.integers(0, 3000, (9, 9, 3))}
    want = {r["asset_id"]: r for r in measure.gamut_fit(pixels_of(spark, images, "rgb")).collect()}
    got = {r["asset_id"]: r for r in gaintiles.gamut_fit(cut(spark, images, 16)).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert [got[k][c] for c in ("samples", "above", "outside", "status")] == [r[c] for c in ("samples", "above", "outside", "status")]
        assert (got[k]["floor"], got[k]["worst"]) == pytest.approx((r["floor"], r["worst"]))
    plan = gaintiles.gamut_fit(cut(spark, images, 16))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def gain_images():
    sdr = {(a, 0): RNG.random((14, 12, 3)) for a in (1, 2)}
    hdr = {k: v * RNG.uniform(0.5, 8, v.shape) for k, v in sdr.items()}
    hdr[2, 0][:3] = -1.0  # no gain there
    return hdr, sdr


@pytest.mark.parametrize("held", [64 << 20, 1])
def test_gain_range_per_channel(spark, monkeypatch, held):
    monkeypatch.setattr(gaintiles, "HELD_BYTES", held)
    hdr, sdr = gain_images()
    got = {(r["asset_id"], r["channel"]): r for r in gaintiles.gain_range(cut(spark, hdr, 64), cut(spark, sdr, 64)).collect()}
    for c in range(3):
        pairs = pixels_of(spark, {k: np.stack([hdr[k][..., c], sdr[k][..., c]], 2) for k in hdr}, ("hdr", "sdr"))
        for r in measure.gain_range(gainmap.log_gains(pairs)).collect():
            own = got[r["asset_id"], c]
            assert (own["n"], own["measured"], own["unmatched"]) == (r["n"], r["measured"], 0)
            assert [own[k] for k in ("low", "high", "abs_min", "abs_max")] == pytest.approx([r[k] for k in ("low", "high", "abs_min", "abs_max")])


@pytest.mark.parametrize("factor,attenuate", [(1, True), (2, True), (4, False)])
def test_gain_map_of_three_channels(spark, factor, attenuate):
    hdr, sdr = gain_images()
    size = (8, 4)
    got = gaintiles.compute_gain_map(cut(spark, hdr, 64, size), cut(spark, sdr, 64, size), factor, attenuate).persist()
    assert {r["status"] for r in got.collect()} == {"ok"}
    for c in range(3):
        pairs = pixels_of(spark, {k: np.stack([hdr[k][..., c], sdr[k][..., c]], 2) for k in hdr}, ("hdr", "sdr"))
        want = {(r["asset_id"], r["y"], r["x"]): r["code"] for r in gainmap.compute_gain_map(pairs, factor, attenuate).collect()}
        own = {(r["asset_id"], r["y"], r["x"]): int(r["code"]) for r in tiles.unpack(got).where(F.col("channel") == c).collect()}
        assert own == want


def test_gain_map_of_images_that_do_not_match(spark):
    hdr, sdr = gain_images()
    a, b = cut(spark, hdr, 64, (8, 4)), cut(spark, sdr, 64, (8, 4), drop={(1, 0, 8, 4)})
    status = {}
    for r in gaintiles.compute_gain_map(a, b).collect():
        status.setdefault(r["asset_id"], set()).add((r["status"], r["buf"] is None))
    assert status == {1: {("length_mismatch", True)}, 2: {("ok", False)}}
    odd = {r["status"] for r in gaintiles.compute_gain_map(cut(spark, hdr, 64, (5, 4)), cut(spark, sdr, 64, (5, 4))).collect()}
    assert odd == {"ok", "unaligned"}
    assert gaintiles.compute_gain_map(a.where("false"), b.where("false")).collect() == []


def test_delivered_codes_are_taken_as_decoded(spark):
    """The SDR side in 8-bit codes equals its linear light given directly."""
    codes = {(1, 0): RNG.integers(0, 256, (12, 12, 1))}
    light = {k: tiles._linear(8)[v] for k, v in codes.items()}
    hdr = {k: v * 3.0 for k, v in light.items()}
    a, b = (gaintiles.compute_gain_map(cut(spark, hdr, 64, (4, 4)), s) for s in (cut(spark, codes, 8, (4, 4)), cut(spark, light, 64, (4, 4))))
    assert (whole(a, (6, 6, 1)) == whole(b, (6, 6, 1))).all()


def sampled(g, w, h):
    gh, gw = g.shape[:2]
    y, x = np.clip((np.arange(h) + 0.5) * gh / h - 0.5, 0, gh - 1), np.clip((np.arange(w) + 0.5) * gw / w - 0.5, 0, gw - 1)
    iy, ix = y.astype(int), x.astype(int)
    jy, jx = np.minimum(iy + 1, gh - 1), np.minimum(ix + 1, gw - 1)
    fy, fx = (y - iy)[:, None, None], (x - ix)[None, :, None]
    return g[iy][:, ix] * (1 - fx) * (1 - fy) + g[iy][:, jx] * fx * (1 - fy) + g[jy][:, ix] * (1 - fx) * fy + g[jy][:, jx] * fx * fy


SIZES = [(1, 40, 30, 10, 8, 3), (2, 17, 23, 17, 23, 1), (3, 9, 33, 2, 5, 3), (4, 12, 12, 1, 1, 1), (5, 6, 6, 12, 9, 3)]


def mixed(spark):
    base = {(a, 0): RNG.random((h, w, 3)) for a, w, h, *_ in SIZES}
    gain = {(a, 0): RNG.random((gh, gw, c)) for a, _, _, gw, gh, c in SIZES}
    sizes = spark.createDataFrame([(a, w, h, gw, gh) for a, w, h, gw, gh, _ in SIZES], "asset_id long, base_w int, base_h int, gain_w int, gain_h int")
    return base, gain, sizes


@pytest.mark.parametrize("cell", [(4, 3), (64, 64), (1, 1)])
def test_upsample_of_mixed_sizes(spark, cell):
    base, gain, sizes = mixed(spark)
    got = gaintiles.upsample(cut(spark, base, 64, (7, 11)), cut(spark, gain, 64, cell), sizes).persist()
    for a, w, h, _, _, c in SIZES:
        assert whole(got.where(F.col("asset_id") == a), (h, w, c)) == pytest.approx(sampled(gain[a, 0], w, h))


def test_reconstruct_of_mixed_sizes(spark):
    base, gain, sizes = mixed(spark)
    meta = spark.createDataFrame([(a, -0.5, float(a), 1.0 + a / 4) for a, *_ in SIZES], "asset_id long, low double, high double, gamma double")
    got = gaintiles.reconstruct(cut(spark, base, 64), cut(spark, gain, 64, (4, 3)), sizes, meta).persist()
    room = gaintiles.reconstruct(cut(spark, base, 64), cut(spark, gain, 64, (4, 3)), sizes, meta.select("asset_id", (F.col("high") + 1.0).alias("headroom")), True).persist()
    for a, w, h, *_ in SIZES:
        g = sampled(gain[a, 0], w, h)
        up = g ** (1 / (1.0 + a / 4))
        want = (base[a, 0] + 1 / 64) * 2.0 ** (-0.5 * (1 - up) + a * up) - 1 / 64
        assert whole(got.where(F.col("asset_id") == a), (h, w, 3)) == pytest.approx(want)
        want = base[a, 0] * (1 + a * np.where(g < 0.081, g / 4.5, ((g + 0.099) / 1.099) ** (1 / 0.45)))
        assert whole(room.where(F.col("asset_id") == a), (h, w, 3)) == pytest.approx(want)


def test_grids_with_holes_say_so(spark):
    base, gain, sizes = mixed(spark)
    holes = cut(spark, gain, 64, (4, 3), drop={(1, 0, 0, 0)}).where("asset_id <> 2")
    got = gaintiles.upsample(cut(spark, base, 64, (10, 10)), holes, sizes.where("asset_id <> 3"))
    status = {}
    for r in got.collect():
        status.setdefault(r["asset_id"], set()).add(r["status"])
    assert status == {1: {"ok", "unmatched"}, 2: {"unmatched"}, 3: {"unmatched"}, 4: {"ok"}, 5: {"ok"}}


def test_stride_of_mixed_sizes(spark):
    base, _, sizes = mixed(spark)
    got = {}
    for r in gaintiles.stride_sample(cut(spark, base, 64, (7, 5)), sizes, 50).collect():
        got.setdefault(r["asset_id"], {})[r["y"], r["x"]] = r["codes"]
    for a, w, h, *_ in SIZES:
        step = max(1, w * h // 50)
        assert got[a] == {(i // w, i % w): base[a, 0][i // w, i % w].tolist() for i in range(0, w * h, step)}


def test_histogram_of_tiles(spark):
    images = {(a, 0): RNG.integers(0, 256, (13, 7, 2)) for a in (1, 2)}
    got = {(r["asset_id"], r["bin"]): r["n"] for r in gaintiles.histogram(cut(spark, images), channel=1).collect()}
    want = {}
    for (a, _), px in images.items():
        for code in px[..., 1].ravel().tolist():
            want[a, code] = want.get((a, code), 0) + 1
    assert got == want
