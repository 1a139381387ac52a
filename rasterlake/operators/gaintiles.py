"""Histograms and gain maps over tiles, with sizes from columns.

Histograms are arrays of fixed length that a task adds its tiles to, image by image, and
sends on as (bin, count) lists when it has seen enough images. So an exchange holds at
most the bins of an image per task, and a window at most the bins of one image: the
pixels are read once. Quantiles, fits and ranges are read off the bins.

Gain maps have any number of channels, each with a range of its own. An SDR side in
codes is taken as a decoder will see it (sRGB codes to linear light); a side of 32 or 64
bits is linear light already. `upsample` and `reconstruct` look up a
coarse grid at base pixels: a base tile names the few grid tiles it touches (its own
cells and one more on each side), these travel to it as buffers, and no pixel becomes a row.

Tiles without a partner, or with other samples than their shape says, are not
measured in part: `status` says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions.color import LUMA_2020, M_2020_TO_709
from rasterlake.functions.gain import GAIN_OFFSET
from rasterlake.operators import measure
from rasterlake.operators.measure import FIT_EPS, FIT_FLOOR, FIT_SHARE, FIT_WORST, GAIN_HIGH, GAIN_LIMIT, GAIN_LOW
from rasterlake.operators.ordered import binned_quantile
from rasterlake.operators.skew import attach
from rasterlake.operators.tiles import SHAPE, STRIP, TILE, TILE_KEY, _buffers, _linear, _pairs, align, sample_type

#: Arrays a task holds before it sends them on. What is sent is copied a few times on its way.
HELD_BYTES = 16 << 20
#: Quarter steps of the 16-bit luminance bins: the floor of the fit is a multiple of one.
FINE = 4 * 65535 + 1
GAIN_BINS = 8192


def _summed(rows: DataFrame, start: Callable[[], list[np.ndarray]], add: Callable[..., None], fields: list[str], kinds: list[T.DataType]) -> DataFrame:
    """asset_id, lists of the fields: arrays of a task by image, those of `fields[1:]` at the places where the first is not 0 (fields[0]: the place).

    add(arrays, batch, row) adds one row. An array of kind double is a minimum, any other a sum; both merge.
    """
    schema = T.StructType([rows.schema["asset_id"], *(T.StructField(f, T.ArrayType(k)) for f, k in zip(fields, kinds, strict=True))])
    arrow = [pa.list_({T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}[k]) for k in kinds]

    def send(held: dict) -> pa.RecordBatch:
        places = [np.flatnonzero(a[0]) for a in held.values()]
        columns = [[p.astype(np.int32) for p in places]] + [[a[i][p] for a, p in zip(held.values(), places, strict=True)] for i in range(len(kinds) - 1)]
        asset = pa.array(list(held), pa_type[0])
        return pa.RecordBatch.from_arrays([asset, *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=["asset_id", *fields])

    pa_type: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            pa_type[0] = batch.column("asset_id").type
            for i, asset in enumerate(batch.column("asset_id").to_pylist()):
                if asset not in held:
                    if size > HELD_BYTES:
                        yield send(held)
                        held, size = {}, 0
                    held[asset] = start()
                    size += sum(a.nbytes for a in held[asset])
                add(held[asset], batch, i)
        if held:
            yield send(held)

    lists = rows.mapInArrow(run, schema)
    return lists.select("asset_id", F.inline(F.arrays_zip(*fields)))


def _samples(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, int]:
    """Rows of interleaved samples of a tile, and its bits."""
    w, h, channels, bits = (batch.column(c)[i].as_py() for c in SHAPE)
    raw = _buffers(batch.column("buf").slice(i, 1))[0]
    return raw.view(sample_type(bits)).reshape(w * h, channels), bits


def histogram(tiles: DataFrame, channel: int = 0, bits: int = 8) -> DataFrame:
    """asset_id, bin, n: how often each code of a channel occurs; codes beyond `bits` count as the last."""
    def add(held, batch, i):
        px, _ = _samples(batch, i)
        held[0] += np.bincount(np.minimum(px[:, channel], 2**bits - 1), minlength=2**bits)

    each = _summed(tiles.select("asset_id", *SHAPE, "buf"), lambda: [np.zeros(2**bits, np.int64)], add, ["bin", "n"], [T.IntegerType(), T.LongType()])
    return each.groupBy("asset_id", "bin").agg(F.sum("n").alias("n"))


def gain_base_class(tiles: DataFrame) -> DataFrame:
    """As measure.gain_base_class, over 8-bit tiles."""
    at = binned_quantile(histogram(tiles), ["asset_id"], "bin", "n", F.greatest(F.ceil(F.col("total") * 0.005), F.lit(1)), out="p05")
    return at.withColumn(
        "base_class", F.when(F.col("p05") <= 8, "zero_based").when(F.col("p05") >= 16, "mid_based").otherwise("undetermined"))


def gamut_fit(tiles: DataFrame) -> DataFrame:
    """As measure.gamut_fit over tiles of linear BT.2020 codes, reading them once.

    A bin of luminance also counts its pixels outside of BT.709 and keeps the worst of them. Where the floor
    falls is known when all bins are; as it lies on the border of a bin, the bins above it give the answer.
    """
    def add(held, batch, i):
        px, bits = _samples(batch, i)
        n, outside, worst = held
        for s in range(0, len(px), STRIP // 4):
            r, g, b = (px[s : s + STRIP // 4, c] / float(2**bits - 1) for c in range(3))
            y = LUMA_2020[0] * r + LUMA_2020[1] * g + LUMA_2020[2] * b
            fine = np.clip(np.floor(y * 65535.0 * 4.0), 0, FINE - 1).astype(np.int64)
            m = M_2020_TO_709
            low = np.minimum(np.minimum(m[0] * r + m[1] * g + m[2] * b, m[3] * r + m[4] * g + m[5] * b), m[6] * r + m[7] * g + m[8] * b)
            out = low < -FIT_EPS
            n += np.bincount(fine, minlength=FINE)
            outside += np.bincount(fine[out], minlength=FINE)
            np.minimum.at(worst, fine[out], low[out])

    each = _summed(tiles.select("asset_id", *SHAPE, "buf"), lambda: [np.zeros(FINE, np.int64), np.zeros(FINE, np.int64), np.zeros(FINE)],
                   add, ["fine", "n", "outside", "worst"], [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType()])
    bins = each.groupBy("asset_id", "fine").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside"), F.min("worst").alias("worst"))
    bins = bins.withColumn("ybin", F.least(F.floor((F.col("fine") + 2) / 4), F.lit(65535)))
    image = Window.partitionBy("asset_id")
    total = F.col("total")
    need = F.greatest(F.least(F.ceil(total * 0.999), total - 1), F.lit(1))
    # The window's default frame takes all rows of the bin in.
    run = bins.withColumn("run", F.sum("n").over(image.orderBy("ybin"))).withColumn("total", F.sum("n").over(image))
    floors = run.withColumn("q", F.min(F.when(F.col("run") >= need, F.col("ybin"))).over(image))
    above = F.col("fine") >= F.greatest(F.lit(4), F.col("q"))
    stats = floors.groupBy("asset_id").agg(
        F.max("total").alias("samples"), F.greatest(F.lit(1.0 / 65535.0), F.max("q") / 65535.0 * FIT_FLOOR).alias("floor"),
        F.sum(F.when(above, F.col("n")).otherwise(0)).alias("above"), F.sum(F.when(above, F.col("outside")).otherwise(0)).alias("outside"),
        F.coalesce(F.min(F.when(above & (F.col("outside") > 0), F.col("worst"))), F.lit(0.0)).alias("worst"))
    share = F.try_divide(F.col("outside"), F.col("above"))
    return stats.withColumn("share", share).withColumn(
        "status", F.when(F.col("above") == 0, "unmeasurable").when((share < FIT_SHARE) & (F.col("worst") > FIT_WORST), "fits").otherwise("exceeds"))


def _light(px: np.ndarray, bits: int) -> np.ndarray:
    """Linear light of samples: of codes as a decoder sees them."""
    return px.astype(np.float64) if px.dtype.kind == "f" else _linear(bits)[px]


def _gains(hdr: np.ndarray, sdr: np.ndarray, hdr_bits: int, sdr_bits: int, floor_at_one: bool) -> np.ndarray:
    """As functions.gain.log2_gain."""
    den = _light(sdr, sdr_bits) + GAIN_OFFSET
    ratio = (_light(hdr, hdr_bits) + GAIN_OFFSET) / np.where(den <= 0.0, 1.0, den)
    if floor_at_one:
        value = np.log2(np.maximum(ratio, 1.0))
    else:
        value = np.where(ratio > 0.0, np.log2(np.where(ratio > 0.0, ratio, 1.0)), -100.0)
    return np.where(den <= 0.0, 0.0, value)


def _sides(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """Samples of both sides of an aligned row (rows x channels) and their bits; None where they do not match. Bits may differ."""
    w, h, channels, bits = (batch.column(c)[i].as_py() for c in SHAPE)
    w2, h2, channels2, bits2 = (batch.column(f"{c}2")[i].as_py() for c in SHAPE)
    if None in (w, h, channels, bits, bits2) or (w, h, channels) != (w2, h2, channels2):
        return None
    sides = [_buffers(batch.column(c).slice(i, 1))[0] for c in ("buf", "buf2")]
    if any(len(s) != w * h * channels * sample_type(b).itemsize for s, b in zip(sides, (bits, bits2), strict=True)):
        return None
    return *(s.view(sample_type(b)).reshape(w * h, channels) for s, b in zip(sides, (bits, bits2), strict=True)), bits, bits2


MOST_CHANNELS = 4


def gain_range(hdr: DataFrame, sdr: DataFrame, floor_at_one: bool = False) -> DataFrame:
    """measure.gain_range per channel: asset_id, channel, n, measured, low, high, abs_min, abs_max, unmatched (tiles)."""
    def add(held, batch, i):
        bins, top = held
        sides = _sides(batch, i)
        if sides is None:
            bins[-1] += 1
            return
        g = _gains(*sides, floor_at_one)
        for c in range(min(g.shape[1], MOST_CHANNELS)):
            kept = g[:, c][(g[:, c] > -GAIN_LIMIT) & (g[:, c] < GAIN_LIMIT)]
            place = np.clip(((kept - GAIN_LOW) / (GAIN_HIGH - GAIN_LOW) * GAIN_BINS).astype(np.int64), 0, GAIN_BINS - 1) + c * GAIN_BINS
            bins += np.bincount(place, minlength=len(bins))
            np.minimum.at(top, place * 2, kept)
            np.minimum.at(top, place * 2 + 1, -kept)

    size = MOST_CHANNELS * GAIN_BINS + 1
    # Two minima a bin: of the gain and of its negative.
    each = _summed_twice(align(hdr, sdr), size, add)
    bins = each.groupBy("asset_id", "place").agg(F.sum("k").alias("k"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    lost = F.col("place") == size - 1
    image = Window.partitionBy("asset_id")
    bins = bins.withColumn("unmatched", F.coalesce(F.sum(F.when(lost, F.col("k"))).over(image), F.lit(0))).where(~lost)
    hist = bins.select("asset_id", F.floor(F.col("place") / GAIN_BINS).cast("int").alias("channel"), (F.col("place") % GAIN_BINS).alias("bin"), "k", "mn", "mx", "unmatched")
    ranges = measure.gain_bounds(hist, ["asset_id", "channel"])
    return ranges.join(hist.groupBy("asset_id", "channel").agg(F.max("unmatched").alias("unmatched")), ["asset_id", "channel"])


def _summed_twice(both: DataFrame, size: int, add) -> DataFrame:
    """asset_id, place, k, mn, mx of a histogram with extremes by bin."""
    def start():
        return [np.zeros(size, np.int64), np.full(2 * size, np.inf)]

    schema = T.StructType([both.schema["asset_id"], T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("k", T.ArrayType(T.LongType())),
                           T.StructField("mn", T.ArrayType(T.DoubleType())), T.StructField("mx", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None

        def send():
            at = [np.flatnonzero(a[0]) for a in held.values()]
            lists = [[p.astype(np.int32) for p in at], [a[0][p] for a, p in zip(held.values(), at, strict=True)],
                     [a[1][p * 2] for a, p in zip(held.values(), at, strict=True)], [-a[1][p * 2 + 1] for a, p in zip(held.values(), at, strict=True)]]
            types = (pa.int32(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, types, strict=True))], names=schema.names)

        for batch in batches:
            kind = batch.column("asset_id").type
            for i, asset in enumerate(batch.column("asset_id").to_pylist()):
                if asset not in held:
                    if len(held) * size * 24 > HELD_BYTES:
                        yield send()
                        held = {}
                    held[asset] = start()
                add(held[asset], batch, i)
        if held:
            yield send()

    return both.mapInArrow(run, schema).select("asset_id", F.inline(F.arrays_zip("place", "k", "mn", "mx")))


def compute_gain_map(hdr: DataFrame, sdr: DataFrame, factor: int = 2, attenuate: bool = True) -> DataFrame:
    """Gain map tiles of 8 bits, with status: log gains, a range per image and channel, bytes, then truncated block means.

    A tile must begin at a multiple of the factor (`unaligned` else). An image with
    a tile that does not match has no range of its own, so none of its tiles has a buffer (`length_mismatch`).
    """
    ranges = gain_range(hdr, sdr, not attenuate)
    low = F.col("low") if attenuate else F.lit(0.0)
    per = ranges.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("channel", low.alias("low"), "high"))).alias("ranges"), F.max("unmatched").alias("unmatched"))
    both = attach(align(hdr, sdr), per, ["asset_id"], ["frame", "y0", "x0"], how="left")
    both = both.select(*TILE, *(f"{c}2" for c in [*SHAPE, "buf"]), F.transform("ranges", lambda r: r["low"]).alias("low"),
                       F.transform("ranges", lambda r: r["high"]).alias("high"), (F.coalesce("unmatched", F.lit(1)) > 0).alias("lost"))

    def coded(batch: pa.RecordBatch, i: int) -> tuple[bytes | None, str]:
        sides = None if batch.column("lost")[i].as_py() else _sides(batch, i)
        if sides is None:
            return None, "length_mismatch"
        y0, x0, w, h = (batch.column(c)[i].as_py() for c in ("y0", "x0", "w", "h"))
        if y0 % factor or x0 % factor:
            return None, "unaligned"
        bounds = [np.array(batch.column(c)[i].as_py()) for c in ("low", "high")]
        g = _gains(*sides, not attenuate)
        channels = g.shape[1]
        if channels > len(bounds[0]):
            return None, "unmeasured"
        lo, hi = (b[:channels] for b in bounds)
        hi = np.where((lo == 0.0) & (hi <= 0.0), 1.0, hi)
        span = hi - lo
        code = np.where(span <= 0.0, 0, np.floor((np.clip(g, lo, hi) - lo) / np.where(span <= 0.0, 1.0, span) * 255.0)).astype(np.int64).reshape(h, w, channels)
        ys, xs = np.arange(0, h, factor), np.arange(0, w, factor)
        total = np.add.reduceat(np.add.reduceat(code, ys, axis=0), xs, axis=1)
        n = np.diff(ys, append=h)[:, None] * np.diff(xs, append=w)[None, :]
        return (total // n[:, :, None]).astype(np.uint8).tobytes(), "ok"

    kept = ["asset_id", "frame", "channels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [coded(batch, i) for i in range(batch.num_rows)]
            place = [pa.array([None if v is None else up(v) for v in batch.column(c).to_pylist()], pa.int32())
                     for c, up in (("y0", lambda v: v // factor), ("x0", lambda v: v // factor), ("w", lambda v: -(-v // factor)), ("h", lambda v: -(-v // factor)))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *place, pa.array([8] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())],
                names=[*kept, "y0", "x0", "w", "h", "bits", "buf", "status"])

    ints = [T.StructField(c, T.IntegerType()) for c in ("y0", "x0", "w", "h", "bits")]
    schema = T.StructType([*(both.schema[c] for c in kept), *ints, T.StructField("buf", T.BinaryType()), T.StructField("status", T.StringType())])
    return both.mapInArrow(run, schema).select(*TILE, "status")


def _at(pos: np.ndarray, size: int, grid: int) -> np.ndarray:
    """Places of base samples on the grid: half-pixel centres, clamped."""
    return np.clip((pos + 0.5) * grid / size - 0.5, 0.0, float(grid - 1))


def _placed(base: DataFrame, gain: DataFrame, sizes: DataFrame) -> DataFrame:
    """Base tiles with their sizes and the grid tiles they touch (`pieces`)."""
    cells = gain.groupBy("asset_id").agg(F.max("w").alias("cell_w"), F.max("h").alias("cell_h"))
    known = sizes.join(cells, "asset_id", "left")
    placed = attach(base.select(*TILE), known, ["asset_id"], ["frame", "y0", "x0"], how="left")

    def cell(first, last, size, grid, side):
        """Numbers of the grid tiles between the first sample's cell and the one behind the last sample's."""
        at = lambda p: F.least(F.greatest((p + 0.5) * F.col(grid) / F.col(size) - 0.5, F.lit(0.0)), F.col(grid) - 1.0)
        end = F.least(F.floor(at(last)) + 1, F.col(grid) - 1)
        return F.explode(F.sequence(F.floor(F.floor(at(first)) / F.col(side)), F.floor(end / F.col(side))))

    wanted = placed.where(F.col("cell_w").isNotNull()).select(
        *TILE_KEY, "w", "base_w", "gain_w", "cell_w", "cell_h", cell(F.col("y0"), F.col("y0") + F.col("h") - 1, "base_h", "gain_h", "cell_h").alias("ty"))
    wanted = wanted.select(
        *TILE_KEY, (F.col("ty") * F.col("cell_h")).cast("int").alias("gy"), "cell_w",
        cell(F.col("x0"), F.col("x0") + F.col("w") - 1, "base_w", "gain_w", "cell_w").alias("tx"))
    wanted = wanted.select(*TILE_KEY, "gy", (F.col("tx") * F.col("cell_w")).cast("int").alias("gx"))
    grid = gain.select("asset_id", "frame", F.col("y0").alias("gy"), F.col("x0").alias("gx"), *(F.col(c).alias(f"g_{c}") for c in [*SHAPE, "buf"]))
    # A base tile touches few grid tiles: its own share of the grid and one tile more.
    pieces = wanted.join(grid, ["asset_id", "frame", "gy", "gx"]).groupBy(*TILE_KEY).agg(
        F.collect_list(F.struct("gy", "gx", *(f"g_{c}" for c in [*SHAPE, "buf"]))).alias("pieces"))
    return placed.join(pieces, TILE_KEY, "left")


def _grid(batch: pa.RecordBatch, i: int) -> np.ndarray | None:
    """Values of the grid at the samples of a base tile (h x w x channels); None where a cell is missing."""
    names = ("y0", "x0", "w", "h", "base_w", "base_h", "gain_w", "gain_h", "pieces")
    y0, x0, w, h, base_w, base_h, gain_w, gain_h, pieces = (batch.column(c)[i].as_py() for c in names)
    if None in (y0, x0, w, h, base_w, base_h, gain_w, gain_h) or not pieces:
        return None
    gy, gx = _at(y0 + np.arange(h), base_h, gain_h), _at(x0 + np.arange(w), base_w, gain_w)
    iy, ix = np.floor(gy).astype(np.int64), np.floor(gx).astype(np.int64)
    jy, jx = np.minimum(iy + 1, gain_h - 1), np.minimum(ix + 1, gain_w - 1)
    top, left = int(iy[0]), int(ix[0])
    region = np.full((int(jy[-1]) - top + 1, int(jx[-1]) - left + 1, pieces[0]["g_channels"]), np.nan)
    for p in pieces:
        bits = p["g_bits"]
        cells = np.frombuffer(p["g_buf"], sample_type(bits)).reshape(p["g_h"], p["g_w"], p["g_channels"])
        y, x = p["gy"] - top, p["gx"] - left
        part = cells[max(-y, 0) : region.shape[0] - y, max(-x, 0) : region.shape[1] - x]
        region[max(y, 0) : max(y, 0) + part.shape[0], max(x, 0) : max(x, 0) + part.shape[1]] = part if bits > 16 else part / float(2**bits - 1)
    fy, fx = (gy - iy)[:, None, None], (gx - ix)[None, :, None]
    a, b = region[iy - top], region[jy - top]
    value = (a[:, ix - left] * (1 - fx) * (1 - fy) + a[:, jx - left] * fx * (1 - fy) + b[:, ix - left] * (1 - fx) * fy + b[:, jx - left] * fx * fy)
    return None if np.isnan(value).any() else value


def _float_tiles(rows: DataFrame, value: Callable[[pa.RecordBatch, int], np.ndarray | None]) -> DataFrame:
    """Tiles of 64 bits, with status, of the values of each row."""
    kept = [*TILE_KEY, "w", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [value(batch, i) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([None if v is None else v.shape[2] for v in out], pa.int32()), pa.array([64] * len(out), pa.int32()),
                 pa.array([None if v is None else v.astype("<f8").tobytes() for v in out], pa.binary()),
                 pa.array(["unmatched" if v is None else "ok" for v in out], pa.string())], names=[*TILE, "status"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("channels", T.IntegerType()), T.StructField("bits", T.IntegerType()),
                           T.StructField("buf", T.BinaryType()), T.StructField("status", T.StringType())])
    return rows.mapInArrow(run, schema)


def upsample(base: DataFrame, gain: DataFrame, sizes: DataFrame) -> DataFrame:
    """The gain at every base pixel, bilinear, as tiles of 64 bits with the base's places.

    sizes: asset_id, base_w, base_h, gain_w, gain_h. gain: tiles of a regular grid. A tile whose image has no
    size, no grid or a grid with holes has no buffer.
    """
    return _float_tiles(_placed(base, gain, sizes).drop("buf"), _grid)


def reconstruct(base: DataFrame, gain: DataFrame, sizes: DataFrame, meta: DataFrame, headroom: bool = False) -> DataFrame:
    """HDR light as tiles of 64 bits. meta: asset_id, low, high, gamma, or asset_id, headroom in the headroom form.

    Codes of the base are taken as a decoder sees them. A gain of one channel serves all of the base's.
    """
    columns = ["headroom"] if headroom else ["low", "high", "gamma"]
    rows = attach(_placed(base, gain, sizes), meta.select("asset_id", *columns), ["asset_id"], ["frame", "y0", "x0"], how="left")

    def light(batch: pa.RecordBatch, i: int) -> np.ndarray | None:
        g, values = _grid(batch, i), [batch.column(c)[i].as_py() for c in columns]
        w, h, channels, bits = (batch.column(c)[i].as_py() for c in SHAPE)
        raw = _buffers(batch.column("buf").slice(i, 1))[0]
        if g is None or None in values or None in (channels, bits) or g.shape[2] not in (1, channels) or len(raw) != w * h * channels * sample_type(bits).itemsize:
            return None
        px = _light(raw.view(sample_type(bits)), bits).reshape(h, w, channels)
        if headroom:
            v = np.clip(g, 0.0, 1.0)
            return px * (1.0 + (values[0] - 1.0) * np.where(v < 0.081, v / 4.5, ((v + 0.099) / 1.099) ** (1 / 0.45)))
        low, high, gamma = values
        g = g ** (1.0 / gamma) if gamma != 1.0 and gamma > 0.0 else g
        return (px + GAIN_OFFSET) * 2.0 ** (low * (1.0 - g) + high * g) - GAIN_OFFSET

    return _float_tiles(rows, light)


def stride_sample(tiles: DataFrame, sizes: DataFrame, target: int = 1_000_000) -> DataFrame:
    """asset_id, frame, y, x, codes (a pixel's samples) of every n-th pixel of an image in flat order, n = max(1, pixels div target).

    sizes: asset_id, base_w, base_h. An image without a size yields nothing.
    """
    stride = F.greatest(F.floor(F.col("base_w").cast("long") * F.col("base_h") / target), F.lit(1))
    rows = attach(tiles.select(*TILE), sizes.select("asset_id", "base_w", stride.alias("stride")), ["asset_id"], ["frame", "y0", "x0"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, xs, codes = [], [], []
            for i in range(batch.num_rows):
                px, _ = _samples(batch, i)
                y0, x0, w, base_w, step = (batch.column(c)[i].as_py() for c in ("y0", "x0", "w", "base_w", "stride"))
                at = np.arange(len(px))
                y, x = y0 + at // max(w, 1), x0 + at % max(w, 1)
                taken = np.flatnonzero((y * base_w + x) % step == 0)
                ys.append(y[taken].astype(np.int32))
                xs.append(x[taken].astype(np.int32))
                codes.append([p.tolist() for p in px[taken].astype(np.float64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("asset_id"), batch.column("frame"), pa.array(ys, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.int32())),
                 pa.array(codes, pa.list_(pa.list_(pa.float64())))], names=["asset_id", "frame", "y", "x", "codes"])

    schema = T.StructType([rows.schema["asset_id"], rows.schema["frame"], T.StructField("y", T.ArrayType(T.IntegerType())),
                           T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return rows.mapInArrow(run, schema).select("asset_id", "frame", F.inline(F.arrays_zip("y", "x", "codes")))
