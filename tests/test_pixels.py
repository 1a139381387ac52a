"""Pixel operators against direct numpy computation."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import gainmap, measure, pixels, quality


def image(spark, values, asset=1):
    h, w = values.shape
    yy, xx = np.mgrid[0:h, 0:w]
    pdf = pd.DataFrame({"asset_id": asset, "y": yy.ravel(), "x": xx.ravel(), "code": values.ravel()})
    return spark.createDataFrame(pdf.astype({"y": "int32", "x": "int32"}))


def to_array(df, value="code"):
    return df.toPandas().pivot(index="y", columns="x", values=value).to_numpy()


@pytest.mark.parametrize("mirror", [-1, 0, 1])
@pytest.mark.parametrize("turns", [0, 1, 2, 3])
def test_orient(spark, mirror, turns):
    img = np.arange(15).reshape(3, 5)
    meta = spark.createDataFrame([(1, 5, 3, mirror, turns)], "asset_id int, w int, h int, mirror int, turns int")
    want = {0: img[:, ::-1], 1: img[::-1, :]}.get(mirror, img)
    assert (to_array(pixels.orient_image(image(spark, img), meta)) == np.rot90(want, turns)).all()


def test_outliers_brute_force(spark):
    rng = np.random.default_rng(3)
    img = rng.integers(0, 255, (13, 9))
    planted = {(4, 4), (6, 2)}
    marks = spark.createDataFrame([(1, y, x) for y, x in planted], "asset_id int, y int, x int")
    got = {(r.y, r.x): (r.n, r.dev) for r in pixels.same_colour_outliers(image(spark, img), marks).collect()}
    for y in range(13):
        for x in range(9):
            near = [img[b, a] for b in range(y - 8, y + 9, 2) for a in range(x - 8, x + 9, 2)
                    if 0 <= b < 13 and 0 <= a < 9 and (b, a) != (y, x) and (b, a) not in planted]
            if len(near) >= 8:
                assert got.pop((y, x)) == (len(near), abs(img[y, x] - np.median(near)))
    assert not got


@pytest.mark.parametrize("size,grid", [((8, 12), (2, 3)), ((5, 7), (3, 4)), ((4, 4), (1, 1)), ((3, 3), (3, 3))])
def test_bilinear_brute_force(spark, size, grid):
    (h, w), (gh, gw) = size, grid
    g = np.random.default_rng(1).random((gh, gw))
    base = image(spark, np.zeros(size, dtype=int))
    got = to_array(gainmap.bilinear(base, image(spark, g).withColumnRenamed("code", "v"), w, h, gw, gh), "gain")
    for y in range(h):
        for x in range(w):
            fx, fy = np.clip((x + .5) * gw / w - .5, 0, gw - 1), np.clip((y + .5) * gh / h - .5, 0, gh - 1)
            x0, y0 = int(fx), int(fy)
            x1, y1 = min(x0 + 1, gw - 1), min(y0 + 1, gh - 1)
            a, b = fx - x0, fy - y0
            want = g[y0, x0] * (1 - a) * (1 - b) + g[y0, x1] * a * (1 - b) + g[y1, x0] * (1 - a) * b + g[y1, x1] * a * b
            assert got[y, x] == pytest.approx(want)


def test_block_mean_edges(spark):
    img = np.arange(35).reshape(5, 7)
    got = {(r.by, r.bx): r["mean"] for r in pixels.block_mean(image(spark, img), 3).collect()}
    assert got == {(y // 3, x // 3): int(img[y:y + 3, x:x + 3].mean()) for y in range(0, 5, 3) for x in range(0, 7, 3)}


def test_unpack_bytes_all_values_and_lengths(spark):
    bufs = [bytes(range(256)), b"", b"\xff", bytes(range(200, 214)), b"\x00" * 8]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bufs)], "asset_id int, buf binary")
    rows = pixels.unpack_bytes(df, "buf", 16).orderBy("asset_id", "pos").toPandas()
    for i, b in enumerate(bufs):
        mine = rows[rows.asset_id == i]
        assert mine.code.tolist() == list(b)
        assert (mine.y * 16 + mine.x).tolist() == list(range(len(b)))


def test_psnr_buffers(spark):
    rng = np.random.default_rng(5)
    a = [rng.integers(0, 256, n, dtype=np.uint8) for n in (1, 6, 7, 8, 1000)]
    b = [rng.integers(0, 256, len(x), dtype=np.uint8) for x in a]

    def frame(parts):
        return spark.createDataFrame([(1, i, bytearray(p.tobytes())) for i, p in enumerate(parts)], "asset_id int, part int, buf binary")

    row = quality.psnr_buffers(frame(a), frame(b)).first()
    assert row.sse == sum(((x.astype(int) - y.astype(int)) ** 2).sum() for x, y in zip(a, b))
    assert row.n == sum(map(len, a))
    for other in ([x[:-1] for x in b], b[:-1], [*b, b[0]], [b[0], np.append(b[1], 0), *b[2:]]):
        row = quality.psnr_buffers(frame(a), frame(other)).first()
        assert (row.psnr, row.sse, row.status) == (None, None, "length_mismatch")


def test_psnr_buffers_without_samples(spark):
    """An image of empty or null buffers is none, and no reason to fail; an empty one beside samples is a part that was lost."""
    def frame(*rows):
        return spark.createDataFrame([(k, part, raw if raw is None else bytearray(raw)) for k, part, raw in rows], "asset_id int, part int, buf binary")

    ref = frame((1, 0, b""), (2, 0, None), (3, 0, b"ab"), (4, 0, b"ab"), (5, 0, b"ab"), (5, 1, b""), (6, 0, b""))
    enc = frame((1, 0, b""), (2, 0, None), (3, 0, b"ac"), (4, 0, b""), (5, 0, b"ab"), (5, 1, None))
    got = {r.asset_id: (r.sse, r.n, r.status) for r in quality.psnr_buffers(ref, enc).collect()}
    assert got == {3: (1, 2, "ok"), 4: (None, 0, "length_mismatch"), 5: (0, 2, "ok")}


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_buffers_are_compared_in_strips(kind, monkeypatch):
    """Sums do not depend on where strips and pieces of a batch end."""
    monkeypatch.setattr(quality, "STRIP", 7)
    rng = np.random.default_rng(8)
    a = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 7, 14, 1, 0, 30, 5, 0)]
    b = [rng.integers(0, 256, len(x) + (i == 5), dtype=np.uint8) for i, x in enumerate(a)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 18)), *(pa.array([x.tobytes() for x in side], kind) for side in (a, b))], names=["asset_id", "a", "b"])
    for some, first in ((batch, 0), (batch.slice(2), 2), (batch.slice(5, 1), 5)):
        out, = quality._buffer_errors(iter([some]))
        pairs = list(zip(a, b))[first : first + some.num_rows]
        assert out.column("asset_id").to_pylist() == list(range(10 + first, 10 + first + some.num_rows))
        assert out.column("sse").to_pylist() == [((x.astype(int) - y) ** 2).sum() if len(x) == len(y) else 0 for x, y in pairs]
        assert out.column("n").to_pylist() == [len(x) if len(x) == len(y) else 0 for x, y in pairs]
        assert out.column("unmatched").to_pylist() == [0 if len(x) == len(y) else len(y) for x, y in pairs]
    assert list(quality._buffer_errors(iter([batch.slice(0, 0)]))) == []


@pytest.mark.parametrize("rows,size", [(10_000, 2_000), (1, 20_000_000)])
def test_a_long_batch_of_buffers_takes_little_memory(rows, size):
    raw = [bytes(size)] * rows
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(raw, pa.binary()), pa.array(raw[1:] + [bytes(size + 1)] if rows > 1 else raw, pa.binary())], names=["asset_id", "a", "b"])
    tracemalloc.start()
    out = list(quality._buffer_errors(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == rows and most < 2 * rows * size


def test_no_score_for_a_part(spark):
    """A truncated frame, a missing tile, a short tile: no score on what happens to overlap."""
    px = [(1, f, y, x, 10 * f + y + x) for f in range(2) for y in range(8) for x in range(8)]
    schema = "asset_id int, frame int, y int, x int, code int"
    ref, cut = spark.createDataFrame(px, schema), spark.createDataFrame(px[:-3], schema)
    for a, b in ((ref, cut), (cut, ref)):
        for got in (quality.psnr(a, b), quality.psnr16(a, b), quality.psnr_multiframe(a, b), quality.ssim_blocks(a, b), quality.max_abs_diff(a, b)):
            row = got.first().asDict()
            assert row["status"] == "length_mismatch"
            assert not any(row.get(k) for k in ("psnr", "sse", "avg_db", "min_db", "max_db", "ssim", "ssim_db", "max_abs"))
    assert quality.psnr(ref, ref).first().status == "ok"
    tiles = lambda *t: spark.createDataFrame([(1, i, s) for i, s in t], "asset_id int, tile int, samples array<int>")
    whole = tiles((0, [1, 2, 3]), (1, [4, 5]))
    for other in (tiles((0, [1, 2, 3])), tiles((0, [1, 2]), (1, [4, 5])), tiles((0, [1, 2, 3]), (1, [4, 5]), (2, [6]))):
        assert quality.psnr_tiles(whole, other).first().status == quality.psnr_tiles(other, whole).first().status == "length_mismatch"
    assert quality.psnr_tiles(whole, whole).first().psnr == float("inf")
    rgb = lambda n: spark.createDataFrame([(1, 0, x, 1, 2, 3) for x in range(n)], "asset_id int, y int, x int, r int, g int, b int")
    assert quality.delta_e_stats(rgb(3), rgb(2)).first().status == "length_mismatch"


def test_stitch_needs_all_tiles(spark):
    tiles = spark.createDataFrame([(1, t, y, x, t * 10 + y * 2 + x) for t in range(4) for y in range(2) for x in range(2)]
                                  + [(2, 0, 0, 0, 5)], "asset_id int, tile int, y int, x int, code int")
    grid = spark.createDataFrame([(a, 2, 2, 2, 2, 3, 4) for a in (1, 2)],
                                 "asset_id int, cols int, rows int, tile_w int, tile_h int, out_w int, out_h int")
    out = pixels.stitch_tiles(tiles, grid)
    assert to_array(out).tolist() == [[0, 1, 10], [2, 3, 12], [20, 21, 30], [22, 23, 32]]
    assert {r.asset_id for r in out.collect()} == {1}


def test_gamut_fit_is_three_valued(spark):
    def px(asset, rgb, n=50):
        return [(asset, i, 0, *rgb) for i in range(n)]

    rows = px(1, (20000, 20000, 20000)) + px(2, (0, 60000, 0)) + px(3, (0, 0, 0))
    df = spark.createDataFrame(rows, "asset_id int, y int, x int, r int, g int, b int")
    got = {r.asset_id: r.status for r in measure.gamut_fit(df).collect()}
    assert got == {1: "fits", 2: "exceeds", 3: "unmeasurable"}


def test_gain_range_needs_samples(spark):
    df = spark.range(99).selectExpr("1 asset_id", "cast(id as double) / 50 g")
    row = measure.gain_range(df).first()
    assert (row.measured, row.low, row.high) == (False, 0.0, 0.0)


@pytest.mark.parametrize("count", [None, "n"])
def test_hot_key_is_cut(spark, count):
    """A key with most rows is split; all rows survive and cold keys are not repeated."""
    from rasterlake.operators.skew import attach
    px = spark.range(20000).selectExpr("case when id % 10 = 0 then id else 1 end asset_id", "cast(id as int) x")
    stats = px.groupBy("asset_id").count().withColumnRenamed("count", "n").withColumn("s", F.col("n") * 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach(px, stats, ["asset_id"], ["x"], count=count, unit=500)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 6000
        assert out.where("s = 36000").count() == 18000 and out.where("s = 2").count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_attach_left_keeps_unmatched(spark):
    from rasterlake.operators.skew import attach
    rows = spark.range(100).selectExpr("id % 5 k", "id v")
    some = spark.createDataFrame([(0, "a"), (1, "b")], "k long, t string")
    got = attach(rows, some, ["k"], ["v"], "left", unit=3)
    assert got.count() == 100
    assert {(r.k, r.t) for r in got.select("k", "t").distinct().collect()} == {(0, "a"), (1, "b"), (2, None), (3, None), (4, None)}
