"""Reshaping and aligning pixel tables.

Two layouts are used. The long form has one row per pixel and is the semantic
definition. The tile form keeps a run of samples as an array: joins then move
one row per tile, and the samples are exploded after the join inside the same
stage as the aggregation, so no pixel is ever shuffled on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.curves import clamp
from rasterlake.functions.media import orient_xy
from rasterlake.operators.skew import attach

PIXEL_KEY = ["asset_id", "frame", "y", "x"]


def unpack_pixels(df: DataFrame, samples: str, width: int, keys=("asset_id",)) -> DataFrame:
    """Flat sample array to one row per sample with its coordinates."""
    return df.select(*keys, F.posexplode(samples).alias("pos", "code")).select(
        *keys, "pos",
        F.floor(F.col("pos") / width).cast("int").alias("y"),
        (F.col("pos") % width).cast("int").alias("x"),
        "code",
    )


WORD = 7  # bytes per word: 56 bits stay inside a positive bigint


def words(df: DataFrame, keys: list[str], buffers: list[str], size: Column) -> DataFrame:
    """Buffers of one row cut into words of seven bytes each.

    Decoding a word costs as much as decoding a byte, so this is seven times
    cheaper than a row per byte, and it stays in generated code: no array of
    samples is built. Yields at (first byte), len and one word per buffer.
    """
    cut = df.withColumn("__size", size).where(F.col("__size") > 0)
    cut = cut.select(*keys, *buffers, "__size", F.explode(F.sequence(F.lit(0), F.col("__size") - 1, F.lit(WORD))).alias("at"))

    def word(buffer):
        return F.conv(F.hex(F.substr(F.col(buffer), F.col("at") + 1, F.lit(WORD))), 16, 10).cast("long")

    return cut.select(
        *keys, "at", F.least(F.lit(WORD), F.col("__size") - F.col("at")).alias("len"),
        *[word(b).alias(b) for b in buffers])


def byte_of(word: str, shift) -> Column:
    shift = shift if isinstance(shift, Column) else F.lit(shift)
    return F.call_function("shiftright", F.col(word), shift).bitwiseAND(F.lit(255).cast("long"))


def unpack_bytes(df: DataFrame, buffer: str, width: int, keys=("asset_id",)) -> DataFrame:
    """Raw 8-bit buffer to one row per byte with its coordinates."""
    cut = words(df, list(keys), [buffer], F.octet_length(buffer))
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    px = each.select(
        *keys, (F.col("at") + F.col("i")).alias("pos"),
        byte_of(buffer, (F.col("len") - 1 - F.col("i")) * 8).cast("int").alias("code"))
    return px.select(
        *keys, "pos", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), "code")


def split_frames(df: DataFrame, samples: str, frame_size: int, width: int, keys=("asset_id",)) -> DataFrame:
    """Concatenated frames to pixel rows; a short tail stays a frame of its own."""
    pos = F.col("pos") % frame_size
    return df.select(*keys, F.posexplode(samples).alias("pos", "code")).select(
        *keys,
        F.floor(F.col("pos") / frame_size).cast("int").alias("frame"),
        F.floor(pos / width).cast("int").alias("y"),
        (pos % width).cast("int").alias("x"),
        "code",
    )


def planar_to_packed(planes: DataFrame, keys=("asset_id", "y", "x")) -> DataFrame:
    """Channel-per-row to channel-per-column; the channel list is fixed, so no
    extra pass looks for pivot values."""
    return planes.groupBy(*keys).pivot("ch", ["r", "g", "b"]).agg(F.max("v"))


def packed_to_planar(px: DataFrame, keys=("asset_id", "y", "x")) -> DataFrame:
    return px.unpivot(list(keys), ["r", "g", "b"], "ch", "v")


def align_pixels(ref: DataFrame, enc: DataFrame, keys=PIXEL_KEY, how: str = "inner") -> DataFrame:
    """Join two renditions on the whole pixel key.

    The coordinates are part of the key, so one huge image spreads over all
    partitions instead of landing on the partition of its asset_id.
    """
    return ref.join(enc, list(keys), how)


def stride_sample(px: DataFrame, width: int, target: int = 1_000_000) -> DataFrame:
    """Every n-th sample of an image in flat order, n = max(1, pixels / target)."""
    sizes = px.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "stride", F.greatest(F.floor(F.col("n") / target), F.lit(1)))
    flat = F.col("y") * width + F.col("x")
    return attach(px, sizes, ["asset_id"], ["y", "x"], count="n").where(F.pmod(flat, F.col("stride")) == 0)


def length_mismatch(a: DataFrame, b: DataFrame, keys=("asset_id", "frame")) -> DataFrame:
    """Frames whose sample counts differ between two renditions."""
    count_a = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    count_b = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    both = count_a.join(count_b, list(keys), "full").fillna(0, ["n_a", "n_b"])
    return both.where(F.col("n_a") != F.col("n_b"))


def plane_identity(a: DataFrame, b: DataFrame, keys=("asset_id", "y", "x")) -> DataFrame:
    """Differing samples and worst difference per image; a missing side fails."""
    left = a.select(*keys, F.col("code").alias("va"))
    right = b.select(*keys, F.col("code").alias("vb"))
    stats = left.join(right, list(keys), "full").groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("va").isNull() | F.col("vb").isNull()).alias("unmatched"),
        F.count_if(F.col("va") != F.col("vb")).alias("differing"),
        F.coalesce(F.max(F.abs(F.col("va") - F.col("vb"))), F.lit(0)).cast("long").alias("max_abs"),
    )
    return stats.withColumn(
        "verdict",
        F.when(F.col("unmatched") > 0, "shape_mismatch").when(F.col("differing") > 0, "differs").otherwise("identical"),
    )


def combine_sample_planes(base: DataFrame, residual: DataFrame, c1: int, c2: int) -> DataFrame:
    """High-bit samples from two planes: c1*s1 + s2/c2, clamped to 16 bit."""
    left = base.select("asset_id", "y", "x", F.col("code").alias("s1"))
    right = residual.select("asset_id", "y", "x", F.col("code").alias("s2"))
    value = F.col("s1").cast("long") * c1 + F.expr(f"s2 div {c2}")
    return left.join(right, ["asset_id", "y", "x"]).select(
        "asset_id", "y", "x", clamp(value, 0, 65535).cast("int").alias("sample"))


def stitch_tiles(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Raster-order tiles onto their canvas, cropped to the declared size.

    tiles: asset_id, tile, y, x, code. grid: asset_id, cols, rows, tile_w,
    tile_h, out_w, out_h. An image with a wrong tile count yields nothing.
    """
    # pixels -> (asset, tile) -> asset: both steps combine before they shuffle
    counted = (
        tiles.groupBy("asset_id", "tile").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("n").alias("n"))
    )
    whole = grid.join(counted, "asset_id").where(F.col("n_tiles") == F.col("cols") * F.col("rows"))
    placed = attach(tiles, whole, ["asset_id"], ["tile", "y", "x"], count="n").select(
        "asset_id",
        (F.floor(F.col("tile") / F.col("cols")) * F.col("tile_h") + F.col("y")).cast("int").alias("y"),
        ((F.col("tile") % F.col("cols")) * F.col("tile_w") + F.col("x")).cast("int").alias("x"),
        "code", "out_w", "out_h",
    )
    return placed.where((F.col("x") < F.col("out_w")) & (F.col("y") < F.col("out_h"))).drop("out_w", "out_h")


def orient_image(px: DataFrame, meta: DataFrame) -> DataFrame:
    """Mirror and rotate images; meta: asset_id, w, h, mirror, turns."""
    p = attach(px, meta, ["asset_id"], ["y", "x"])
    at = orient_xy(p["x"], p["y"], p["w"], p["h"], p["mirror"], p["turns"])
    return p.select("asset_id", at["y"].alias("y"), at["x"].alias("x"), "code")


def block_mean(px: DataFrame, factor: int, value: str = "code") -> DataFrame:
    """Mean over factor x factor blocks, truncated; edge blocks hold fewer pixels."""
    return px.groupBy(
        "asset_id",
        F.floor(F.col("y") / factor).cast("int").alias("by"),
        F.floor(F.col("x") / factor).cast("int").alias("bx"),
    ).agg(F.floor(F.sum(value) / F.count(F.lit(1))).cast("int").alias("mean"))


def same_colour_outliers(px: DataFrame, planted: DataFrame | None = None, radius: int = 4, step: int = 2,
                         least: int = 8) -> DataFrame:
    """Deviation of a sample from the median of its same-colour neighbours.

    Neighbours lie at even offsets up to radius*step in both directions. Two
    range windows, one along rows and one along columns, collect them: each
    row moves twice instead of once per neighbour. A window spans one image
    line, whose length the image format bounds, and each frame holds at most
    (2*radius + 1)^2 samples.
    """
    reach = radius * step
    if planted is None:
        marked = px.withColumn("planted", F.lit(False))
    else:
        points = planted.select("asset_id", "y", "x", F.lit(True).alias("planted"))
        marked = px.join(points, ["asset_id", "y", "x"], "left").fillna(False, ["planted"])
    value = F.when(~F.col("planted"), F.col("code"))
    along_x = Window.partitionBy("asset_id", "y").orderBy("x").rangeBetween(-reach, reach)
    along_y = Window.partitionBy("asset_id", "x").orderBy("y").rangeBetween(-reach, reach)
    lines = marked.withColumn("line", F.collect_list(F.struct(F.col("x").alias("at"), value.alias("v"))).over(along_x))
    lines = lines.withColumn("line", F.filter("line", lambda s: (s["at"] - F.col("x")) % step == 0))
    square = lines.withColumn(
        "square", F.collect_list(F.struct(F.col("y").alias("at"), F.col("line"))).over(along_y))
    around = F.flatten(F.transform(
        F.filter("square", lambda s: (s["at"] - F.col("y")) % step == 0),
        lambda row: F.transform(
            F.filter(row["line"], lambda s: s["v"].isNotNull()
                     & ~((row["at"] == F.col("y")) & (s["at"] == F.col("x")))),
            lambda s: s["v"]),
    ))
    return (
        square.select("asset_id", "y", "x", "code", F.array_sort(around).alias("near"))
        .withColumn("n", F.size("near"))
        .where(F.col("n") >= least)
        .withColumn("median", (
            F.element_at("near", F.expr("cast((n - 1) div 2 + 1 as int)"))
            + F.element_at("near", F.expr("cast(n div 2 + 1 as int)"))) / 2.0)
        .select("asset_id", "y", "x", "n", F.abs(F.col("code") - F.col("median")).alias("dev"))
    )
