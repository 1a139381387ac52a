"""The colour transform over tiles: one scan serves images of different plans.

`colorspace.transform_pixels` is the definition, one row a pixel and one plan a call. Here a
row is a tile and names its plan; the plans are a bounded vocabulary that the call
holds as numbers. A task builds the tables of a plan when it first meets it and
keeps them. Samples are worked on in strips, and batches in pieces, so neither a tile's size nor
the number of tiles in a batch sets the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions import arrays, color
from rasterlake.llm.textkit import slices
from rasterlake.operators.colorspace import Transform
from rasterlake.operators.tiles import SHAPE, TILE, TILE_KEY, _buffers, sample_type

#: Pixels of a strip: a few MB in double precision, which the processor's caches still hold.
PIXELS = 1 << 16
#: Bytes of buffers, or one tile, that are transformed before they are passed on.
PIECE = 4 << 20
#: Plans a call may name; their tables are at most a few MB each.
MOST_PLANS = 256


class Kernel:
    """One plan, from source codes to target codes of `bits` (8 or 16)."""

    def __init__(self, plan: Transform, bits: int) -> None:
        self.plan, self.bits = plan, bits
        self.encode = arrays.encoder(plan.dst, 8 if bits == 8 and not plan.dither else 16)
        self.offsets = np.array(color.BAYER_4X4).reshape(4, 4) / 16.0 - 7.5 / 16.0

    def linear(self, codes: np.ndarray, top: int) -> arrays.RGB:
        """Linear light in the target's terms, before it is encoded."""
        plan = self.plan
        table = arrays.decode_table(plan.src, top)
        rgb = tuple(table[codes[:, c]] for c in range(3))
        if plan.src_scene_peak:
            rgb = tuple(v / plan.src_scene_peak for v in arrays.ootf(rgb, plan.src_scene_peak))
        if plan.linear_scale != 1.0:
            rgb = tuple(v * plan.linear_scale for v in rgb)
        if plan.tone:
            rgb = arrays.tone_map(rgb, plan.tone, plan.peak_nits, plan.dst)
        if plan.matrix:
            rgb = arrays.apply_matrix(rgb, plan.matrix)
        if plan.gamut_keep is not None:
            rgb = arrays.gamut_compress(rgb, plan.luminances, plan.gamut_keep)
        if plan.encode_scale != 1.0:
            rgb = tuple(v * plan.encode_scale for v in rgb)
        if plan.dst_scene_peak:
            rgb = arrays.ootf_inverse(tuple(v * plan.dst_scene_peak for v in rgb), plan.dst_scene_peak)
        return rgb

    def __call__(self, px: np.ndarray, bits: int, y0: int, x0: int, w: int) -> np.ndarray:
        """px: rows of R, G, B and perhaps further samples, the pixels of a tile in order. Further samples are rescaled alone."""
        top = 2**bits - 1
        # A source wider than 8 bits may hold codes above its depth; they are the depth's last one.
        px = np.minimum(px, top) if bits not in (8, 16) else px
        out = np.empty(px.shape, sample_type(self.bits))
        for s in range(0, len(px), PIXELS):
            part = px[s : s + PIXELS]
            for c, v in enumerate(self.linear(part, top)):
                code = self.encode(v)
                if self.bits == 8 and self.plan.dither:
                    at = np.arange(s, s + len(part))
                    offset = self.offsets[(y0 + at // w) & 3, (x0 + at % w) & 3]
                    code = np.clip(np.floor(code / 65535.0 * 255.0 + offset + 0.5), 0, 255)
                out[s : s + len(part), c] = code
            if px.shape[1] > 3:
                last = 255 if self.bits == 8 else 65535
                out[s : s + len(part), 3:] = np.floor(part[:, 3:] / float(top) * last + 0.5)
        return out


def transform_tiles(tiles: DataFrame, plans: Mapping[str, Transform], plan: str = "plan", bits: int = 8) -> DataFrame:
    """The tiles in their plan's target codes, with the plan and a status.

    tiles: as in `tiles`, at least three channels of at most 16 bits, and the name of a plan. A tile whose plan is unknown or null, or that
    has other samples than its shape says, has no buffer and says why.
    """
    if bits not in (8, 16) or len(plans) > MOST_PLANS:
        raise ValueError(f"8 or 16 bits, and at most {MOST_PLANS} plans")
    known = dict(plans)
    whole = tiles.select(*TILE, F.col(plan).alias("plan"))
    kept = [*TILE_KEY, "w", "h", "channels", "plan"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels: dict[str, Kernel] = {}
        for batch in (piece for whole in batches for piece in slices(whole, "buf", PIECE)):
            names = batch.column("plan").to_pylist()
            place = [batch.column(c).to_pylist() for c in ("y0", "x0", *SHAPE)]
            out, status = [], []
            for i, raw in enumerate(_buffers(batch.column("buf"))):
                y0, x0, w, h, channels, depth = (c[i] for c in place)
                if names[i] not in known:
                    out.append(None)
                    status.append("unknown_plan")
                elif None in (w, h, channels, depth) or channels < 3 or depth > 16 or len(raw) != w * h * channels * sample_type(depth).itemsize:
                    out.append(None)
                    status.append("unusable")
                else:
                    kernel = kernels.setdefault(names[i], None) or Kernel(known[names[i]], bits)
                    kernels[names[i]] = kernel
                    out.append(kernel(raw.view(sample_type(depth)).reshape(-1, channels), depth, y0, x0, w).tobytes())
                    status.append("ok")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([bits] * len(out), pa.int32()), pa.array(out, pa.binary()), pa.array(status, pa.string())],
                names=[*kept, "bits", "buf", "status"])

    schema = T.StructType([*(whole.schema[c] for c in kept), T.StructField("bits", T.IntegerType()), T.StructField("buf", T.BinaryType()), T.StructField("status", T.StringType())])
    return whole.mapInArrow(run, schema)


def channel_sums(tiles: DataFrame) -> DataFrame:
    """asset_id, n (pixels), sums (one number a channel): a checksum of whole images that moves no pixel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = [batch.column(c).to_pylist() for c in ("channels", "bits")]
            n, sums = [], []
            for i, raw in enumerate(_buffers(batch.column("buf"))):
                px = raw.view(sample_type(shape[1][i])).reshape(-1, shape[0][i])
                n.append(len(px))
                sums.append(px.sum(0, dtype=np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("asset_id"), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["asset_id", "n", "sums"])

    schema = T.StructType([tiles.schema["asset_id"], T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    each = tiles.select("asset_id", "channels", "bits", "buf").mapInArrow(run, schema)
    rows = each.select("asset_id", "n", F.posexplode("sums").alias("c", "s")).groupBy("asset_id", "c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return rows.groupBy("asset_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda x: x["s"]).alias("sums"))
