"""Images as tiles: one binary buffer per rectangle, compared and reshaped where it lies.

A tile table has asset_id, frame, y0, x0 (place of the tile's first sample), w, h,
channels, bits and buf. A buffer holds rows of interleaved samples: one byte each
up to 8 bits, little-endian two bytes up to 16, float32 at 32 and float64 at 64.
(asset_id, frame, y0, x0) names a tile once. A huge image is many tiles,
so joins move one row per tile, and no pixel becomes a row.

Renditions are joined in full. Each pair of buffers goes through one kernel that
leaves sums for the tile; these add up to frames and images. A
tile without a partner, of another shape or depth, or whose buffer is shorter than its
shape says, counts as unmatched and leaves its image without a score
(`length_mismatch`), never with the score of a part.

Kernels look at one pair at a time, in strips of `STRIP` samples, so what they need
does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions.color import LAB_XN, LAB_ZN
from rasterlake.functions.curves import linear_value, named_curve
from rasterlake.functions.matrices import colorants_d50
from rasterlake.model import PRIMARIES
from rasterlake.operators.quality import psnr_of
from rasterlake.operators.skew import attach

TILE_KEY = ["asset_id", "frame", "y0", "x0"]
SHAPE = ["w", "h", "channels", "bits"]
TILE = [*TILE_KEY, *SHAPE, "buf"]
#: Samples a kernel widens at once.
STRIP = 1 << 20


def sample_type(bits: int) -> np.dtype:
    return np.dtype("u1" if bits <= 8 else "<u2" if bits <= 16 else "<f4" if bits == 32 else "<f8")


def _buffers(column: pa.Array) -> list[np.ndarray]:
    """The bytes of every row, without copies; a null is empty."""
    column = column.fill_null(b"")
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def from_arrays(df: DataFrame, samples: str, channels: int | Column = 1, bits: int = 8) -> DataFrame:
    """Tiles of rows with asset_id, frame, y0, x0, w, h and an array of samples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("buf").fill_null([]) if batch.num_rows else batch.column("buf")
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(sample_type(bits))
            at = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]) if batch.num_rows else [0]
            bufs = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("buf"), "buf", bufs)

    shaped = df.select(*TILE_KEY, "w", "h", (channels if isinstance(channels, Column) else F.lit(channels)).cast("int").alias("channels"),
                       F.lit(bits).alias("bits"), F.col(samples).alias("buf"))
    return shaped.mapInArrow(run, T.StructType([*shaped.schema.fields[:-1], T.StructField("buf", T.BinaryType())]))


def unpack(tiles: DataFrame) -> DataFrame:
    """asset_id, frame, y, x, channel, code: one row a sample, for looking at small images."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [raw[: len(raw) // sample_type(b).itemsize * sample_type(b).itemsize].view(sample_type(b)).astype(np.float64)
                    for raw, b in zip(_buffers(batch.column("buf")), batch.column("bits").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("buf"), "buf", pa.array(rows, pa.list_(pa.float64())))

    whole = tiles.select(*TILE)
    schema = T.StructType([*whole.schema.fields[:-1], T.StructField("buf", T.ArrayType(T.DoubleType()))])
    at = F.floor(F.col("i") / F.col("channels"))
    return whole.mapInArrow(run, schema).select(*TILE_KEY, "w", "channels", F.posexplode("buf").alias("i", "code")).select(
        "asset_id", "frame", (F.col("y0") + F.floor(at / F.col("w"))).cast("int").alias("y"), (F.col("x0") + at % F.col("w")).cast("int").alias("x"),
        (F.col("i") % F.col("channels")).cast("int").alias("channel"), "code")


def align(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """Tiles of two renditions side by side (columns of the second with a 2), those without a partner included."""
    other = enc.select(*TILE_KEY, *(F.col(c).alias(f"{c}2") for c in [*SHAPE, "buf"]))
    return ref.select(*TILE).join(other, TILE_KEY, "full")


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None, int]]:
    """(row, samples, samples of the other side, unmatched): no samples where the pair does not match."""
    shapes = [[batch.column(c + s).to_pylist() for c in SHAPE] for s in ("", "2")]
    for i, (a, b) in enumerate(zip(_buffers(batch.column("buf")), _buffers(batch.column("buf2")), strict=True)):
        sa, sb = ([c[i] for c in shape] for shape in shapes)
        size = [0 if None in s else s[0] * s[1] * s[2] for s in (sa, sb)]
        bits = sa[3] or sb[3] or 8
        each = sample_type(bits).itemsize
        if sa == sb and None not in sa and len(a) == len(b) == size[0] * each:
            yield i, a.view(sample_type(bits)), b.view(sample_type(bits)), 0
        else:
            yield i, None, None, max(*size, len(a) // each, len(b) // each, 1)


def _measured(both: DataFrame, fields: dict[str, T.DataType], kernel: Callable[..., Iterator[tuple]]) -> DataFrame:
    """asset_id, frame, bits, unmatched and the fields, from rows that kernel(a, b, shape) yields for a matched pair."""
    schema = T.StructType([both.schema["asset_id"], both.schema["frame"], T.StructField("bits", T.IntegerType()), T.StructField("unmatched", T.LongType()),
                           *(T.StructField(n, t) for n, t in fields.items())])
    empty = (None,) * len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            place = [batch.column(c).to_pylist() for c in ("y0", "x0", *SHAPE)]
            row, lost, out = [], [], []
            for i, a, b, unmatched in _pairs(batch):
                for values in [empty] if a is None else kernel(a, b, *(c[i] for c in place)):
                    row.append(i)
                    lost.append(unmatched)
                    out.append(values)
            bits = [a if a is not None else b for a, b in zip(batch.column("bits").to_pylist(), batch.column("bits2").to_pylist(), strict=True)]
            take = pa.array(row, pa.int64())
            arrow = arrow or [_arrow(t) for t in fields.values()]
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column("asset_id").take(take), batch.column("frame").take(take), pa.array(bits, pa.int32()).take(take), pa.array(lost, pa.int64()),
                 *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.names)

    return both.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}[kind]


def _whole(scores: DataFrame, *columns: str) -> DataFrame:
    """Scores of whole images alone, and why one has none."""
    status = F.when(F.col("unmatched") > 0, "length_mismatch").when(F.col("low") != F.col("top"), "mixed_bits").otherwise("ok")
    ok = F.col("status") == "ok"
    return scores.withColumn("status", status).withColumns({c: F.when(ok, F.col(c)) for c in columns}).drop("unmatched", "low", "top")


def _lost() -> list[Column]:
    return [F.sum("unmatched").alias("unmatched"), F.min("bits").alias("low"), F.max("bits").alias("top")]


def _code_errors(a: np.ndarray, b: np.ndarray, *shape) -> Iterator[tuple]:
    if a.dtype.kind != "u":
        raise ValueError("errors of codes need at most 16 bits")
    sse = top = differing = 0
    for s in range(0, len(a), STRIP):
        d = np.subtract(a[s : s + STRIP], b[s : s + STRIP], dtype=np.int32)
        f = d.astype(np.float64)
        sse += int(f @ f)  # under 2**52 a strip, so exact
        top, differing = max(top, int(np.abs(d).max())), differing + int(np.count_nonzero(d))
    yield len(a), sse, top, differing


def errors(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """n, sse, max_abs, differing, unmatched, low and top (bits) of every frame."""
    fields = {c: T.LongType() for c in ("n", "sse", "max_abs", "differing")}
    return _measured(align(ref, enc), fields, _code_errors).groupBy("asset_id", "frame").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "sse", "differing")), F.coalesce(F.max("max_abs"), F.lit(0)).alias("max_abs"), *_lost())


def _again(frames: DataFrame, *more: Column) -> DataFrame:
    return frames.groupBy("asset_id").agg(*more, F.sum("unmatched").alias("unmatched"), F.min("low").alias("low"), F.max("top").alias("top"))


def _peak() -> Column:
    return F.pow(F.lit(2.0), F.col("low")) - 1.0


def _db() -> Column:
    """Of nothing matched, no score."""
    return psnr_of(F.col("sse"), F.nullif(F.col("n"), F.lit(0)), _peak())


def psnr(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """asset_id, n, sse, psnr, status over all samples, channels and frames; the peak is that of the tiles' bits."""
    scores = _again(errors(ref, enc), F.sum("n").alias("n"), F.sum("sse").alias("sse"))
    return _whole(scores.withColumn("psnr", _db()), "sse", "psnr")


def psnr_multiframe(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """Average from the global error, extremes over frames; a short last frame is a frame."""
    frames = errors(ref, enc).withColumn("db", _db())
    scores = _again(frames, F.count(F.lit(1)).alias("frames"), F.sum("n").alias("n"), F.sum("sse").alias("sse"),
                    F.min("db").alias("min_db"), F.max("db").alias("max_db"))
    return _whole(scores.withColumn("avg_db", _db()).drop("n", "sse"), "avg_db", "min_db", "max_db")


def max_abs_diff(ref: DataFrame, enc: DataFrame) -> DataFrame:
    return _whole(_again(errors(ref, enc), F.max("max_abs").alias("max_abs")), "max_abs")


def plane_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differing samples and worst difference per image; a side that lacks samples fails."""
    stats = _again(errors(a, b), F.sum("n").alias("matched"), F.sum("differing").alias("differing"), F.max("max_abs").alias("max_abs"))
    return stats.select(
        "asset_id", (F.col("matched") + F.col("unmatched")).alias("samples"), "unmatched", "differing", "max_abs",
        F.when(F.col("unmatched") > 0, "shape_mismatch").when(F.col("differing") > 0, "differs").otherwise("identical").alias("verdict"))


def _block_moments(a: np.ndarray, b: np.ndarray, y0: int, x0: int, w: int, h: int, channels: int, bits: int, win: int) -> Iterator[tuple]:
    """Sums per block and channel: (by, bx, channel, blocks, ssim, n, sa, sb, saa, sbb, sab).

    Blocks that lie inside the tile as a whole are scored here, as one row with by = -1.
    """
    bx = (x0 + np.arange(w)) // win
    left = np.flatnonzero(np.diff(bx, prepend=bx[0] - 1))
    lines = max(win, STRIP // max(1, w * channels) // win * win)
    a, b = a.reshape(h, w, channels), b.reshape(h, w, channels)
    done, total, start = 0, 0.0, 0
    while start < h:
        stop = min(h, (y0 + start) // win * win + lines - y0)
        by = (y0 + np.arange(start, stop)) // win
        top = np.flatnonzero(np.diff(by, prepend=by[0] - 1))
        p, q = a[start:stop].astype(np.int64), b[start:stop].astype(np.int64)
        n = (np.diff(top, append=stop - start)[:, None] * np.diff(left, append=w)[None, :])[:, :, None].repeat(channels, 2)
        sums = [np.add.reduceat(np.add.reduceat(v, top, axis=0), left, axis=1) for v in (p, q, p * p, q * q, p * q)]
        whole = n == win * win
        if whole.any():
            scores = _ssim(n[whole].astype(np.float64), *(s[whole] for s in sums), float(2**bits - 1))
            done, total = done + len(scores), total + float(scores.sum())
        for i, j, c in zip(*np.nonzero(~whole), strict=True):
            yield (int(by[top[i]]), int(bx[left[j]]), int(c), 0, 0.0, int(n[i, j, c]), *(int(s[i, j, c]) for s in sums))
        start = stop
    if done:
        yield (-1, -1, -1, done, total, *(None,) * 6)


def _ssim(n, sa, sb, saa, sbb, sab, peak):
    """Similarity of a block from its sums; for arrays and for columns."""
    c1, c2 = (0.01 * peak) * (0.01 * peak), (0.03 * peak) * (0.03 * peak)
    ma, mb = sa / n, sb / n
    va, vb, cov = saa / n - ma * ma, sbb / n - mb * mb, sab / n - ma * mb
    return ((ma * mb * 2.0 + c1) * (cov * 2.0 + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def ssim(ref: DataFrame, enc: DataFrame, win: int = 8) -> DataFrame:
    """asset_id, blocks, ssim, ssim_db, status: mean over win x win blocks of every channel and frame.

    A block that tiles cut is put together from the sums of its parts.
    """
    moments = ("n", "sa", "sb", "saa", "sbb", "sab")
    fields = {c: T.IntegerType() for c in ("by", "bx", "channel")} | {"blocks": T.LongType(), "ssim": T.DoubleType()} | {c: T.LongType() for c in moments}
    parts = _measured(align(ref, enc), fields, lambda a, b, *shape: _block_moments(a, b, *shape, win))
    blocks = parts.groupBy("asset_id", "frame", "by", "bx", "channel").agg(*(F.sum(c).alias(c) for c in ("blocks", "ssim", *moments)), *_lost())
    cut = F.col("by") >= 0
    value = F.when(cut, _ssim(*(F.col(c).cast("double") for c in moments), _peak())).otherwise(F.col("ssim"))
    scores = _again(
        blocks.withColumn("ssim", value).withColumn("blocks", F.when(cut, F.lit(1)).otherwise(F.col("blocks"))),
        F.sum("blocks").alias("blocks"), F.try_divide(F.sum("ssim"), F.sum("blocks")).alias("ssim"))
    scores = scores.withColumn("ssim_db", F.when(F.col("ssim") >= 1.0, F.lit(float("inf"))).otherwise(F.log10(F.lit(1.0) - F.col("ssim")) * -10.0))
    return _whole(scores, "ssim", "ssim_db")


_lab_tables: dict[int, np.ndarray] = {}


def _linear(bits: int) -> np.ndarray:
    """Linear light of every sRGB code of so many bits."""
    if bits not in _lab_tables:
        srgb, top = named_curve("iec61966-2-1"), 2**bits - 1
        _lab_tables[bits] = np.array([linear_value(i / top, srgb) for i in range(top + 1)])
    return _lab_tables[bits]


def _lab(codes: np.ndarray, bits: int) -> np.ndarray:
    """CIE Lab under D50 of rows of R, G, B codes."""
    xyz = _linear(bits)[codes] @ np.array(colorants_d50(*PRIMARIES["bt709"])).reshape(3, 3).T / (LAB_XN, 1.0, LAB_ZN)
    f = np.where(xyz > 0.008856, np.cbrt(xyz), xyz * 7.787 + 16.0 / 116.0)
    return np.stack([f[:, 1] * 116.0 - 16.0, (f[:, 0] - f[:, 1]) * 500.0, (f[:, 1] - f[:, 2]) * 200.0], 1)


def _lab_distance(a: np.ndarray, b: np.ndarray, y0: int, x0: int, w: int, h: int, channels: int, bits: int) -> Iterator[tuple]:
    if channels < 3 or bits > 16:
        raise ValueError("a colour difference needs R, G, B codes of at most 16 bits")
    a, b = (x.reshape(-1, channels)[:, :3] for x in (a, b))
    total, worst = 0.0, 0.0
    for s in range(0, len(a), STRIP // 8):
        d = _lab(a[s : s + STRIP // 8], bits) - _lab(b[s : s + STRIP // 8], bits)
        de = np.sqrt((d * d).sum(1))
        total, worst = total + float(de.sum()), max(worst, float(de.max()))
    yield len(a), total, worst


def delta_e(ref: DataFrame, enc: DataFrame) -> DataFrame:
    """asset_id, mean_de, max_de, status: CIE76 difference of sRGB tiles; a fourth channel is left out."""
    parts = _measured(align(ref, enc), {"n": T.LongType(), "total": T.DoubleType(), "worst": T.DoubleType()}, _lab_distance)
    return _whole(parts.groupBy("asset_id").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean_de"), F.max("worst").alias("max_de"), *_lost()), "mean_de", "max_de")


def _rewritten(tiles: DataFrame, more: list[str], change: Callable[..., bytes]) -> DataFrame:
    """Tiles whose buffer is change(samples as h x w x channels, *values of the further columns). Rows with a null there keep theirs."""
    kept = [c for c in tiles.columns if c not in ("buf", *more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = [batch.column(c).to_pylist() for c in SHAPE]
            values = [batch.column(c).to_pylist() for c in more]
            out = []
            for i, raw in enumerate(_buffers(batch.column("buf"))):
                w, h, channels, bits = (c[i] for c in shape)
                own = [c[i] for c in values]
                out.append(raw.tobytes() if None in own else change(raw.view(sample_type(bits)).reshape(h, w, channels), *own))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "buf"])

    return tiles.mapInArrow(run, T.StructType([*(tiles.schema[c] for c in kept), T.StructField("buf", T.BinaryType())]))


def combine_planes(base: DataFrame, residual: DataFrame, c1: int, c2: int) -> DataFrame:
    """16-bit tiles c1 * s1 + s2 div c2, clamped, and status; a tile whose sides do not match has no buffer."""
    both = align(base, residual)
    kept = [*TILE_KEY, *SHAPE[:3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if a is None else np.clip(a.astype(np.int64) * c1 + b.astype(np.int64) // c2, 0, 65535).astype("<u2").tobytes()
                   for _, a, b, _ in _pairs(batch)]
            status = ["length_mismatch" if x is None else "ok" for x in out]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([16] * len(out), pa.int32()), pa.array(out, pa.binary()), pa.array(status)],
                names=[*TILE, "status"])

    schema = T.StructType([*(both.schema[c] for c in kept), T.StructField("bits", T.IntegerType()), T.StructField("buf", T.BinaryType()), T.StructField("status", T.StringType())])
    return both.mapInArrow(run, schema)


def stitch(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Raster-order tiles at their places on the canvas, cropped to the declared size.

    tiles: asset_id, frame, tile (number), w, h, channels, bits, buf. grid: asset_id, cols,
    rows, tile_w, tile_h, out_w, out_h. An image with a wrong tile count yields nothing.
    """
    counted = tiles.groupBy("asset_id", "frame").agg(F.count(F.lit(1)).alias("n")).groupBy("asset_id").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("n"))
    size = F.col("cols") * F.col("rows")
    whole = grid.join(counted, "asset_id").where((F.col("least") == size) & (F.col("most") == size)).drop("least", "most")
    placed = attach(tiles, whole, ["asset_id"], ["frame", "tile"], count="n").select(
        "*", (F.floor(F.col("tile") / F.col("cols")) * F.col("tile_h")).cast("int").alias("y0"),
        ((F.col("tile") % F.col("cols")) * F.col("tile_w")).cast("int").alias("x0"))
    keep_w, keep_h = F.least("w", F.col("out_w") - F.col("x0")), F.least("h", F.col("out_h") - F.col("y0"))
    cut = (keep_w < F.col("w")) | (keep_h < F.col("h"))
    placed = placed.where((keep_w > 0) & (keep_h > 0)).select(
        *TILE, F.when(cut, keep_w).cast("int").alias("keep_w"), F.when(cut, keep_h).cast("int").alias("keep_h"), keep_w.cast("int").alias("new_w"), keep_h.cast("int").alias("new_h"))
    out = _rewritten(placed, ["keep_w", "keep_h"], lambda px, w, h: px[:h, :w].tobytes())
    return out.withColumns({"w": F.col("new_w"), "h": F.col("new_h")}).select(*TILE)


def orient(tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """Mirror (0 left-right, 1 up-down), then counter-clockwise quarter turns. meta: asset_id, img_w, img_h, mirror, turns."""
    p = attach(tiles.select(*TILE), meta, ["asset_id"], ["frame", "y0", "x0"])
    mx = F.when(F.col("mirror") == 0, F.col("img_w") - F.col("x0") - F.col("w")).otherwise(F.col("x0"))
    my = F.when(F.col("mirror") == 1, F.col("img_h") - F.col("y0") - F.col("h")).otherwise(F.col("y0"))
    turns = F.col("turns")
    right, below = F.col("img_w") - mx - F.col("w"), F.col("img_h") - my - F.col("h")
    x0 = F.when(turns == 1, my).when(turns == 2, right).when(turns == 3, below).otherwise(mx)
    y0 = F.when(turns == 1, right).when(turns == 2, below).when(turns == 3, mx).otherwise(my)
    still = F.coalesce(~F.col("mirror").isin(0, 1) & ~turns.isin(1, 2, 3), F.lit(True))
    side = turns.isin(1, 3)
    placed = p.select(
        "asset_id", "frame", y0.cast("int").alias("new_y0"), x0.cast("int").alias("new_x0"), *SHAPE, "buf",
        F.when(~still, F.coalesce("mirror", F.lit(-1))).alias("mirror"), F.when(~still, F.coalesce("turns", F.lit(0))).alias("turns"), side.alias("side"))

    def turned(px: np.ndarray, mirror: int, turns: int) -> bytes:
        px = px[:, ::-1] if mirror == 0 else px[::-1] if mirror == 1 else px
        return np.ascontiguousarray(np.rot90(px, turns)).tobytes()

    out = _rewritten(placed, ["mirror", "turns"], turned)
    return out.select(
        "asset_id", "frame", F.col("new_y0").alias("y0"), F.col("new_x0").alias("x0"),
        F.when(F.col("side"), F.col("h")).otherwise(F.col("w")).alias("w"), F.when(F.col("side"), F.col("w")).otherwise(F.col("h")).alias("h"), "channels", "bits", "buf")
