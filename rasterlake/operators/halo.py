"""Neighbourhood operators over tiles that carry the borders of their neighbours.

A tile sends each tile around it the part of its samples that lies in that one's apron;
a tile and what it was sent, a few buffers, meet in one group and are laid out as one padded
array. A pixel travels as often as it lies in an apron, not once per neighbour, and no
pixel is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.operators.skew import attach
from rasterlake.operators.tiles import SHAPE, TILE, TILE_KEY, _buffers, sample_type

#: Samples whose neighbours are sorted at once: each has (2 * radius + 1)**2 of them in memory.
SORTED = 1 << 15


def _pieces(reach: int):
    """Of every tile: itself (own), and the parts of it in the aprons of the tiles around it, by the number of the tile they are for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[] for _ in range(7)]
            place = [batch.column(c).to_pylist() for c in ("y0", "x0", "w", "h", "bits", "tile_w", "tile_h", "points")]
            for i, raw in enumerate(_buffers(batch.column("buf"))):
                y0, x0, w, h, bits, tile_w, tile_h, points = (c[i] for c in place)
                px = raw.view(sample_type(bits)).reshape(h, w).astype(np.float32)
                masked = px.copy()
                for p in points or ():
                    masked[p["y"] - y0, p["x"] - x0] = np.nan
                ty, tx = y0 // tile_h, x0 // tile_w
                ry, rx = -(-reach // tile_h), -(-reach // tile_w)
                for dy in range(-ry, ry + 1):
                    for dx in range(-rx, rx + 1):
                        if dy == dx == 0:
                            part, a, b, own = masked, 0, 0, px.tobytes()
                        else:
                            # The target's rectangle and its apron, cut with this tile.
                            top, left = (ty + dy) * tile_h - reach, (tx + dx) * tile_w - reach
                            a, b = max(0, top - y0), max(0, left - x0)
                            part, own = masked[a : max(0, top + tile_h + 2 * reach - y0), b : max(0, left + tile_w + 2 * reach - x0)], None
                        if part.size and ty + dy >= 0 and tx + dx >= 0:
                            rows.append(i)
                            for column, value in zip(out, (ty + dy, tx + dx, y0 + a, x0 + b, part.shape[1], part.tobytes(), own), strict=True):
                                column.append(value)
            take = pa.array(rows, pa.int64())
            kinds = [pa.int32()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("asset_id").take(take), batch.column("frame").take(take), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                names=["asset_id", "frame", "ty", "tx", "y", "x", "w", "buf", "own"])

    return run


def _deviation(padded: np.ndarray, own: np.ndarray, reach: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours each sample has, and how far it is from their median."""
    h, w = own.shape
    n, dev = np.empty((h, w)), np.empty((h, w))
    offsets = [(dy, dx) for dy in range(0, 2 * reach + 1, step) for dx in range(0, 2 * reach + 1, step) if (dy, dx) != (reach, reach)]
    lines = max(1, SORTED // max(w, 1))
    for s in range(0, h, lines):
        e = min(h, s + lines)
        # Absent neighbours are last in the order.
        around = np.sort(np.stack([padded[s + dy : e + dy, dx : dx + w] for dy, dx in offsets]), axis=0)
        k = (~np.isnan(around)).sum(0)
        low, high = (np.take_along_axis(around, np.clip(i, 0, len(offsets) - 1)[None], 0)[0].astype(np.float64) for i in ((k - 1) // 2, k // 2))
        n[s:e], dev[s:e] = k, np.abs(own[s:e] - (low + high) / 2.0)
    return n, dev


def same_colour_deviation(tiles: DataFrame, planted: DataFrame | None = None, radius: int = 4, step: int = 2, least: int = 8) -> DataFrame:
    """Tiles of two channels, as pixels.same_colour_outliers: the number of same-colour neighbours, and the deviation from their median.

    tiles: one channel, at most 16 bits, cut on a regular grid. planted: asset_id, y, x of samples that are no one's neighbour (frame 0).
    A sample with fewer than `least` neighbours has the deviation NaN.
    """
    reach = radius * step
    grid = tiles.groupBy("asset_id").agg(F.max("w").alias("tile_w"), F.max("h").alias("tile_h"), F.count(F.lit(1)).alias("n"))
    whole = attach(tiles.select(*TILE), grid, ["asset_id"], ["frame", "y0", "x0"], count="n").drop("n")
    point = "array<struct<y:int,x:int>>"
    if planted is None:
        whole = whole.withColumn("points", F.lit(None).cast(point))
    else:
        # A tile has at most as many points as samples.
        at = lambda c, side: (F.floor(F.col(c) / F.col(side)) * F.col(side)).cast("int")
        points = attach(planted, grid.drop("n"), ["asset_id"], ["y", "x"]).groupBy(
            "asset_id", F.lit(0).alias("frame"), at("y", "tile_h").alias("y0"), at("x", "tile_w").alias("x0")).agg(
            F.collect_set(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))).alias("points"))
        whole = whole.join(points, TILE_KEY, "left")
    ints = [T.StructField(c, T.IntegerType()) for c in ("ty", "tx", "y", "x", "w")]
    sent = whole.mapInArrow(_pieces(reach), T.StructType([tiles.schema["asset_id"], tiles.schema["frame"], *ints, T.StructField("buf", T.BinaryType()), T.StructField("own", T.BinaryType())]))
    met = sent.groupBy("asset_id", "frame", "ty", "tx").agg(
        F.max_by(F.struct("y", "x", "w", "own"), F.col("own").isNotNull()).alias("self"), F.collect_list(F.struct("y", "x", "w", "buf")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for me, pieces in zip(batch.column("self").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                w = me["w"]
                own = np.frombuffer(me["own"], np.float32).reshape(-1, w).astype(np.float64)
                padded = np.full((own.shape[0] + 2 * reach, w + 2 * reach), np.nan, np.float32)
                for p in pieces:
                    part = np.frombuffer(p["buf"], np.float32).reshape(-1, p["w"])
                    y, x = p["y"] - me["y"] + reach, p["x"] - me["x"] + reach
                    part = part[max(0, -y) : max(0, padded.shape[0] - y), max(0, -x) : max(0, padded.shape[1] - x)]
                    padded[max(0, y) : max(0, y) + part.shape[0], max(0, x) : max(0, x) + part.shape[1]] = part
                n, dev = _deviation(padded, own, reach, step)
                rows.append((me["y"], me["x"], w, own.shape[0], np.stack([n, np.where(n >= least, dev, np.nan)], 2).astype("<f8").tobytes()))
            y0, x0, w, h, buf = zip(*rows, strict=True) if rows else [()] * 5
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("asset_id"), batch.column("frame"), *(pa.array(c, pa.int32()) for c in (y0, x0, w, h, [2] * k, [64] * k)), pa.array(buf, pa.binary())], names=TILE)

    schema = T.StructType([tiles.schema["asset_id"], tiles.schema["frame"], *(T.StructField(c, T.IntegerType()) for c in ("y0", "x0", *SHAPE)), T.StructField("buf", T.BinaryType())])
    return met.where("self.own is not null").mapInArrow(run, schema)
