"""Tile kernels against direct numpy computation, and against the long form."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import arrays, color
from rasterlake.functions.curves import Curve, PARAMETRIC, from_linear, named_curve
from rasterlake.operators import gaintiles, halo, quality, tiles, transform
from rasterlake.operators.colorspace import Transform, transform_pixels

RNG = np.random.default_rng(12)
CURVES = ["linear", "smpte2084", "arib-std-b67", *PARAMETRIC]


def cut(spark, images, bits=8, size=(5, 4), drop=()):
    """A tile table of {(asset, frame): h x w x channels}; drop: tiles to leave out."""
    rows = []
    for (asset, frame), px in images.items():
        h, w, c = px.shape
        for y in range(0, h, size[0]):
            for x in range(0, w, size[1]):
                part = px[y : y + size[0], x : x + size[1]]
                if (asset, frame, y, x) not in drop:
                    raw = part.astype(tiles.sample_type(bits)).tobytes()
                    rows.append((asset, frame, y, x, part.shape[1], part.shape[0], c, bits, raw))
    schema = "asset_id long, frame int, y0 int, x0 int, w int, h int, channels int, bits int, buf binary"
    return spark.createDataFrame(rows, schema).repartition(3)


def long_form(spark, images):
    rows = [(a, f, y * px.shape[2] + c, x, int(px[y, x, c])) for (a, f), px in images.items() for y, x, c in np.ndindex(px.shape)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["asset_id", "frame", "y", "x", "code"]))


@pytest.mark.parametrize("bits,channels", [(8, 1), (8, 3), (8, 4), (10, 1), (10, 3), (16, 1), (16, 4)])
def test_psnr_of_any_depth_and_channels(spark, bits, channels):
    top = 2**bits
    ref = {(a, f): RNG.integers(0, top, (11, 9, channels)) for a in (1, 2) for f in (0, 1)}
    enc = {k: np.clip(v + RNG.integers(-3, 4, v.shape) * (k != (2, 0)), 0, top - 1) for k, v in ref.items()}
    enc[2, 1] = ref[2, 1]
    got = {r["asset_id"]: r for r in tiles.psnr(cut(spark, ref, bits), cut(spark, enc, bits)).collect()}
    sse = sum(int(((ref[1, f] - enc[1, f]) ** 2).sum()) for f in (0, 1))
    n = 2 * ref[1, 0].size
    assert got[1]["sse"] == sse and got[1]["n"] == n and got[1]["psnr"] == pytest.approx(10 * np.log10((top - 1) ** 2 * n / sse))
    assert got[2]["psnr"] == float("inf") and {r["status"] for r in got.values()} == {"ok"}
    top_diff = {r["asset_id"]: r["max_abs"] for r in tiles.max_abs_diff(cut(spark, ref, bits), cut(spark, enc, bits)).collect()}
    assert top_diff == {a: max(int(np.abs(ref[a, f] - enc[a, f]).max()) for f in (0, 1)) for a in (1, 2)}


def test_strips_add_up(spark, monkeypatch):
    monkeypatch.setattr(tiles, "STRIP", 7)
    ref = {(1, 0): RNG.integers(0, 256, (9, 8, 1))}
    enc = {(1, 0): RNG.integers(0, 256, (9, 8, 1))}
    # The kernels run in this process here.
    (a,), (b,) = ref.values(), enc.values()
    flat = [x.astype(np.uint8).ravel() for x in (a, b)]
    d = a - b
    assert list(tiles._code_errors(*flat)) == [(72, int((d * d).sum()), int(np.abs(d).max()), int((d != 0).sum()))]


def test_images_that_do_not_match_have_no_score(spark):
    px = {(a, 0): RNG.integers(0, 256, (10, 8, 1)) for a in range(6)}
    ref = cut(spark, px)
    enc = cut(spark, px, drop={(0, 0, 5, 4)}).where("asset_id <> 5")
    enc = enc.withColumn("buf", F.when((F.col("asset_id") == 1) & (F.col("y0") == 5), F.expr("substring(buf, 1, 10)")).otherwise(F.col("buf")))
    enc = enc.withColumn("w", F.when(F.col("asset_id") == 2, 5).otherwise(F.col("w"))).withColumn("bits", F.when(F.col("asset_id") == 3, 7).otherwise(F.col("bits")))
    want = {0: "length_mismatch", 1: "length_mismatch", 2: "length_mismatch", 3: "length_mismatch", 4: "ok", 5: "length_mismatch"}
    for score, column in ((tiles.psnr, "psnr"), (tiles.psnr_multiframe, "avg_db"), (tiles.ssim, "ssim"), (tiles.max_abs_diff, "max_abs")):
        for a, b in ((ref, enc), (enc, ref)):
            got = {r["asset_id"]: r for r in score(a, b).collect()}
            assert {k: r["status"] for k, r in got.items()} == want
            assert [k for k, r in got.items() if r[column] is not None] == [4]
    planes = {r["asset_id"]: (r["verdict"], r["unmatched"], r["samples"]) for r in tiles.plane_identity(ref, enc).collect()}
    assert planes[0] == ("shape_mismatch", 20, 80) and planes[4] == ("identical", 0, 80) and planes[5] == ("shape_mismatch", 80, 80)
    combined = {(r["asset_id"], r["y0"], r["x0"]): (r["status"], r["buf"] is None) for r in tiles.combine_planes(ref, enc, 3, 2).collect()}
    assert combined[0, 5, 4] == ("length_mismatch", True) and combined[0, 0, 0] == ("ok", False) and len(combined) == 6 * 4
    assert tiles.psnr(ref.where("false"), enc.where("false")).collect() == []


@pytest.mark.parametrize("size", [(16, 16), (5, 4), (8, 8), (24, 3)])
def test_ssim_is_the_same_however_it_is_cut(spark, size):
    ref = {(1, f): RNG.integers(0, 256, (21, 19, 1)) for f in (0, 1)}
    enc = {k: np.clip(v + RNG.integers(-30, 31, v.shape), 0, 255) for k, v in ref.items()}
    want = quality.ssim_blocks(long_form(spark, ref), long_form(spark, enc)).first()
    got = tiles.ssim(cut(spark, ref, size=size), cut(spark, enc, size=size)).first()
    assert got["blocks"] == want["blocks"] == 18 and got["ssim"] == pytest.approx(want["ssim"], rel=1e-12)


def test_colour_difference(spark):
    ref, enc = ({(1, 0): RNG.integers(0, 256, (7, 6, 4))} for _ in range(2))

    def rgb(images):
        rows = [(1, y, x, *map(int, images[1, 0][y, x, :3])) for y in range(7) for x in range(6)]
        return spark.createDataFrame(rows, "asset_id long, y int, x int, r int, g int, b int")

    want = quality.delta_e_stats(rgb(ref), rgb(enc)).first()
    got = tiles.delta_e(cut(spark, ref), cut(spark, enc)).first()
    assert got["mean_de"] == pytest.approx(want["mean_de"], rel=1e-9) and got["max_de"] == pytest.approx(want["max_de"], rel=1e-9)
    same = tiles.delta_e(cut(spark, {(1, 0): ref[1, 0] * 257}, 16), cut(spark, {(1, 0): enc[1, 0] * 257}, 16)).first()
    assert same["mean_de"] == pytest.approx(want["mean_de"], rel=1e-9)


def test_plans_move_no_pixels(spark):
    px = {(1, 0): RNG.integers(0, 256, (10, 8, 3))}
    for score in (tiles.psnr, tiles.psnr_multiframe, tiles.ssim, tiles.delta_e, tiles.plane_identity):
        plan = score(cut(spark, px), cut(spark, px))._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("MapInArrow") == 1
        # Exchanges before the kernel move tiles by their key, the ones behind it sums.
        assert all("hashpartitioning(asset_id" in line for line in plan.split("\n") if "Exchange hash" in line)


@pytest.mark.parametrize("mirror", [-1, 0, 1, None])
@pytest.mark.parametrize("turns", [0, 1, 2, 3])
def test_orient_tiles(spark, mirror, turns):
    img = RNG.integers(0, 256, (11, 9, 3))
    meta = spark.createDataFrame([(1, 9, 11, mirror, turns)], "asset_id long, img_w int, img_h int, mirror int, turns int")
    want = np.rot90({0: img[:, ::-1], 1: img[::-1]}.get(mirror, img), turns)
    assert (whole(tiles.orient(cut(spark, {(1, 0): img}), meta), want.shape) == want).all()


def whole(table, shape):
    out = np.full(shape, -1.0)
    for r in tiles.unpack(table).collect():
        out[r["y"], r["x"], r["channel"]] = r["code"]
    return out


def test_stitch_crops(spark):
    img = RNG.integers(0, 65536, (10, 12, 3))
    table = cut(spark, {(1, 0): img, (2, 0): img}, 16, size=(5, 4), drop={(2, 0, 5, 8)})
    numbered = table.withColumn("tile", (F.col("y0") / 5 * 3 + F.col("x0") / 4).cast("int")).drop("y0", "x0")
    grid = spark.createDataFrame([(a, 3, 2, 4, 5, 9, 7) for a in (1, 2)], "asset_id long, cols int, rows int, tile_w int, tile_h int, out_w int, out_h int")
    got = tiles.stitch(numbered, grid)
    assert {r["asset_id"] for r in got.select("asset_id").collect()} == {1}
    assert (whole(got, (7, 9, 3)) == img[:7, :9]).all()


@pytest.mark.parametrize("name", CURVES)
def test_encoder_is_the_formula(spark, name):
    curve = named_curve(name)
    v = np.concatenate([[-0.5, 0.0, 1.0, 1.5, 1e-12], 10.0 ** RNG.uniform(-12, 0, 4000), RNG.random(4000)])
    rows = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(v)), "v": v})).select(
        "i", color.encode16(F.col("v"), curve).alias("wide"), color.quantize8(color.encode16(F.col("v"), curve).cast("double")).alias("narrow")).toPandas().sort_values("i")
    assert (arrays.encoder(curve, 16)(v) == rows["wide"].to_numpy()).all()
    assert (arrays.encoder(curve, 8)(v) == rows["narrow"].to_numpy()).all()
    formula = spark.createDataFrame(pd.DataFrame({"v": v[4:]})).select(from_linear(F.col("v"), curve).alias("e")).toPandas()["e"].to_numpy()
    assert arrays.from_linear(v[4:], curve) == pytest.approx(formula, rel=1e-9, abs=1e-12)


def test_a_kernel_refuses_what_it_cannot_do(spark):
    with pytest.raises(ValueError):
        arrays.encoder(Curve("table"), 8)
    with pytest.raises(ValueError):
        transform.transform_tiles(cut(spark, {(1, 0): np.zeros((1, 1, 3))}).withColumn("plan", F.lit("p")), {}, bits=12)


PLANS = {
    "tone_" + mode: Transform(named_curve("smpte2084"), named_curve("bt709"), (1.66, -0.58, -0.08, -0.12, 1.13, -0.01, -0.02, -0.1, 1.12), linear_scale=49.0, tone=mode)
    for mode in ("reinhard", "hable", "mobius", "bt2446a")
} | {
    "scene": Transform(named_curve("iec61966-2-1"), named_curve("arib-std-b67"), linear_scale=0.2, dst_scene_peak=1000.0, dither=True),
    "display": Transform(named_curve("arib-std-b67"), named_curve("bt470m"), src_scene_peak=1000.0, gamut_keep=0.7, matrix=(1.4, -0.3, -0.1, 0, 1.1, -0.1, 0, -0.2, 1.2)),
    "plain": Transform(named_curve("prophoto"), named_curve("iec61966-2-1")),
}


def test_transform_by_plan_equals_the_long_form(spark, monkeypatch):
    """Every step, all plans in one table, tiles with odd places, strips of a few pixels."""
    monkeypatch.setattr(transform, "PIXELS", 7)
    names = list(PLANS)
    images = {(i, 0): RNG.integers(0, 256, (9, 11, 3)) for i in range(len(names))}
    table = cut(spark, images).withColumn("plan", F.element_at(F.array(*map(F.lit, names)), F.col("asset_id").cast("int") + 1))
    got = {r["asset_id"]: r for r in transform.transform_tiles(table, PLANS).groupBy("asset_id").agg(F.collect_set("status").alias("s")).collect()}
    assert all(r["s"] == ["ok"] for r in got.values())
    done = transform.transform_tiles(table, PLANS).persist()
    for i, name in enumerate(names):
        rows = [(y, x, *map(int, images[i, 0][y, x])) for y in range(9) for x in range(11)]
        px = transform_pixels(spark.createDataFrame(rows, "y int, x int, r int, g int, b int"), PLANS[name]).collect()
        out = whole(done.where(F.col("asset_id") == i), (9, 11, 3))
        want = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in px}
        bad = [k for k, v in want.items() if tuple(out[k]) != v]
        assert not bad, (name, bad[:3])


def test_transform_of_odd_tiles(spark):
    img = RNG.integers(0, 1024, (4, 4, 4))
    table = cut(spark, {(i, 0): img for i in range(4)}, 10, (4, 4)).withColumn("plan", F.when(F.col("asset_id") == 1, "none").when(F.col("asset_id") == 2, None).otherwise("plain"))
    table = table.withColumn("buf", F.when(F.col("asset_id") == 3, F.expr("substring(buf, 1, 9)")).otherwise(F.col("buf")))
    got = {r["asset_id"]: r for r in transform.transform_tiles(table, PLANS, bits=16).collect()}
    assert [got[i]["status"] for i in range(4)] == ["ok", "unknown_plan", "unknown_plan", "unusable"]
    out = np.frombuffer(got[0]["buf"], "<u2").reshape(4, 4, 4)
    linear = arrays.to_linear(img[..., :3] / 1023, named_curve("prophoto"))
    assert (out[..., :3] == np.floor(arrays.from_linear(linear, named_curve("iec61966-2-1")) * 65535 + 0.5)).all()
    assert (out[..., 3] == np.floor(img[..., 3] / 1023 * 65535 + 0.5)).all()


@pytest.mark.parametrize("size", [(4, 5), (16, 16), (3, 64)])
def test_deviation_at_tile_borders(spark, size, monkeypatch):
    monkeypatch.setattr(halo, "SORTED", 40)
    images = {(a, 0): RNG.integers(0, 65536, (21, 19, 1)) for a in (1, 2)}
    images[3, 0] = RNG.integers(0, 65536, (2, 3, 1))
    planted = {(1, y, x) for y, x in ((4, 4), (6, 2), (20, 18), (0, 0))}
    marks = spark.createDataFrame(sorted(planted), "asset_id long, y int, x int")
    whole_ = halo.same_colour_deviation(cut(spark, images, 16, size), marks)
    got = {}
    for r in tiles.unpack(whole_).collect():
        got.setdefault((r["asset_id"], r["y"], r["x"]), {})[r["channel"]] = r["code"]
    want = {}
    for (a, _), px in images.items():
        h, w, _ = px.shape
        for y in range(h):
            for x in range(w):
                near = [px[j, i, 0] for j in range(y % 2, h, 2) for i in range(x % 2, w, 2) if abs(j - y) <= 8 and abs(i - x) <= 8 and (j, i) != (y, x) and (a, j, i) not in planted]
                want[a, y, x] = len(near), abs(px[y, x, 0] - np.median(near)) if len(near) >= 8 else None
    assert {k: (v[0], None if np.isnan(v[1]) else v[1]) for k, v in got.items()} == want
    assert "Window" not in whole_._jdf.queryExecution().executedPlan().toString()


class Local:
    """A tile table that keeps the kernel it is given, to be run in this process."""

    schema = "asset_id long, frame int, y0 int, x0 int, w int, h int, channels int, bits int, plan string, buf binary"

    def __init__(self):
        from pyspark.sql.types import StructType
        self.schema = StructType.fromDDL(self.schema)

    def select(self, *_):
        return self

    groupBy = agg = select

    def mapInArrow(self, run, _):
        self.run = run
        return self

    @staticmethod
    def batch(n, size):
        columns = {"asset_id": np.arange(n), **{c: np.zeros(n, np.int32) for c in ("frame", "y0", "x0")}, "w": np.full(n, size, np.int32), "h": np.ones(n, np.int32)}
        return pa.RecordBatch.from_pydict({**columns, "channels": np.full(n, 3, np.int32), "bits": np.full(n, 8, np.int32), "plan": ["srgb"] * n, "buf": [bytes([i % 256]) * size * 3 for i in range(n)]})


def test_a_long_batch_is_transformed_in_pieces(spark):
    local, plan = Local(), Transform(named_curve("iec61966-2-1"), named_curve("iec61966-2-1"))
    transform.transform_tiles(local, {"srgb": plan})
    out = list(local.run(iter([local.batch(600, 10_000)])))
    assert len(out) > 4 and max(b.nbytes for b in out) < 5 << 20
    assert [x.as_py()[:1] for b in out for x in b.column("buf")] == [bytes([i % 256]) for i in range(600)]


def test_histograms_are_sent_a_few_mb_at_once(spark):
    """Of 20,000 images with a tile each, 2 KB an image."""
    local = Local()
    gaintiles.histogram(local)
    out = list(local.run(iter([local.batch(10_000, 1), local.batch(10_000, 1)])))
    assert sum(b.num_rows for b in out) == 20_000 and max(b.num_rows for b in out) * 2048 < 17 << 20
