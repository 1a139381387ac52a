"""Gain maps: computing them from an SDR/HDR pair and applying them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.gain import GAIN_OFFSET, apply_gain, apply_gain_headroom, gain_to_byte, log2_gain
from rasterlake.operators.measure import gain_range
from rasterlake.operators.skew import attach


def reconcile_meta(iso: DataFrame, xmp: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Two metadata sources per asset into one; XMP wins where ranges disagree.

    iso: asset_id, iso_min, iso_max, iso_gamma, iso_offset_sdr, iso_offset_hdr,
    iso_cap. xmp: the same with xmp_, and base_is_hdr. Where the ranges agree,
    only a missing capacity is filled and the direction flag carried over;
    assets without XMP keep their ISO values.
    """
    both = iso.join(xmp, "asset_id", "left")
    apart = F.coalesce(
        (F.abs(F.col("xmp_max") - F.col("iso_max")) > tolerance)
        | (F.abs(F.col("xmp_min") - F.col("iso_min")) > tolerance), F.lit(False))

    def taken(name):
        return F.when(apart, F.col(f"xmp_{name}")).otherwise(F.col(f"iso_{name}"))

    return both.select(
        "asset_id", taken("min").alias("gain_min"), taken("max").alias("gain_max"),
        F.when(apart & (F.col("xmp_gamma") > 0.0), F.col("xmp_gamma")).otherwise(F.col("iso_gamma")).alias("gamma"),
        taken("offset_sdr").alias("offset_sdr"), taken("offset_hdr").alias("offset_hdr"),
        F.when(F.col("iso_cap") == 0.0, F.coalesce("xmp_cap", "iso_cap")).otherwise(F.col("iso_cap")).alias("cap_max"),
        F.coalesce(F.col("base_is_hdr"), F.lit(False)).alias("base_is_hdr"),
        apart.alias("took_xmp"),
    )


def log_gains(pairs: DataFrame, floor_at_one: bool = False) -> DataFrame:
    """pairs: asset_id, y, x, hdr, sdr in linear light."""
    return pairs.select("asset_id", "y", "x", log2_gain(F.col("hdr"), F.col("sdr"), floor_at_one).alias("g"))


def compute_gain_map(pairs: DataFrame, factor: int = 2, attenuate: bool = True) -> DataFrame:
    """Log gains, their range per image, bytes, then block means.

    With attenuate the low bound may drop below zero; otherwise gains are
    floored at one and the low bound is zero.
    """
    gains = log_gains(pairs, floor_at_one=not attenuate)
    bounds = gain_range(gains).select(
        "asset_id", (F.col("low") if attenuate else F.lit(0.0)).alias("low"), "high", "n")
    coded = attach(gains, bounds, ["asset_id"], ["y", "x"], count="n").select(
        "asset_id", "y", "x", gain_to_byte(F.col("g"), F.col("high"), F.col("low")).alias("code"))
    return coded.groupBy(
        "asset_id",
        F.floor(F.col("y") / factor).cast("int").alias("y"),
        F.floor(F.col("x") / factor).cast("int").alias("x"),
    ).agg(F.floor(F.sum("code") / F.count(F.lit(1))).cast("int").alias("code"))


def bilinear(base: DataFrame, gain: DataFrame, base_w: int, base_h: int, gain_w: int, gain_h: int) -> DataFrame:
    """Sample a low-resolution grid at full-resolution pixels.

    Half-pixel centres, clamped, four weighted neighbours. The four neighbours
    are packed on the small grid first, so the full-resolution side joins once
    on (asset_id, y0, x0) and is neither multiplied by four nor aggregated.
    """
    cell = gain.select("asset_id", F.col("y").alias("gy"), F.col("x").alias("gx"), F.col("v"))
    corners = F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)])
    # A cell serves as corner (dy, dx) of the origin (gy - dy, gx - dx); at the
    # far edge the clamped corner is the edge cell itself.
    offered = cell.withColumn("c", F.explode(corners)).select(
        "asset_id", "v",
        F.explode(F.array_distinct(F.array_compact(F.array(
            F.struct((F.col("gy") - F.col("c.dy")).alias("y0"), (F.col("gx") - F.col("c.dx")).alias("x0"),
                     F.col("c.dy").alias("dy"), F.col("c.dx").alias("dx")),
            F.when((F.col("c.dy") == 1) & (F.col("gy") == gain_h - 1), F.struct(
                F.col("gy").alias("y0"), (F.col("gx") - F.col("c.dx")).alias("x0"),
                F.col("c.dy").alias("dy"), F.col("c.dx").alias("dx"))),
            F.when((F.col("c.dx") == 1) & (F.col("gx") == gain_w - 1), F.struct(
                (F.col("gy") - F.col("c.dy")).alias("y0"), F.col("gx").alias("x0"),
                F.col("c.dy").alias("dy"), F.col("c.dx").alias("dx"))),
            F.when((F.col("c.dy") == 1) & (F.col("gy") == gain_h - 1)
                   & (F.col("c.dx") == 1) & (F.col("gx") == gain_w - 1), F.struct(
                F.col("gy").alias("y0"), F.col("gx").alias("x0"),
                F.col("c.dy").alias("dy"), F.col("c.dx").alias("dx"))),
        )))).alias("o"),
    )
    packed = offered.groupBy("asset_id", F.col("o.y0").alias("y0"), F.col("o.x0").alias("x0")).agg(*[
        F.max(F.when((F.col("o.dy") == dy) & (F.col("o.dx") == dx), F.col("v"))).alias(f"v{dy}{dx}")
        for dy in (0, 1) for dx in (0, 1)
    ])

    def at(pos, size, grid):
        return F.least(F.greatest((pos + 0.5) * grid / size - 0.5, F.lit(0.0)), F.lit(float(grid - 1)))

    placed = base.withColumn("__gy", at(F.col("y"), base_h, gain_h)).withColumn("__gx", at(F.col("x"), base_w, gain_w))
    placed = placed.withColumn("y0", F.floor("__gy").cast("int")).withColumn("x0", F.floor("__gx").cast("int"))
    fy, fx = F.col("__gy") - F.col("y0"), F.col("__gx") - F.col("x0")
    one = F.lit(1.0)
    value = (
        F.col("v00") * (one - fx) * (one - fy) + F.col("v01") * fx * (one - fy)
        + F.col("v10") * (one - fx) * fy + F.col("v11") * fx * fy
    )
    return (
        placed.join(packed, ["asset_id", "y0", "x0"])
        .withColumn("gain", value)
        .drop("__gy", "__gx", "y0", "x0", "v00", "v01", "v10", "v11")
    )


def reconstruct_hdr(base: DataFrame, gain: DataFrame, meta: DataFrame, base_w: int, base_h: int, gain_w: int,
                    gain_h: int, headroom: bool = False) -> DataFrame:
    """HDR light from a base image (column base), a gain grid and its metadata.

    meta: asset_id, low, high, gamma, or asset_id, headroom in the headroom form.
    """
    sampled = bilinear(base, gain, base_w, base_h, gain_w, gain_h)
    px = attach(sampled, meta, ["asset_id"], ["y", "x"])
    if headroom:
        value = apply_gain_headroom(F.col("base"), F.col("gain"), F.col("headroom"))
    else:
        value = apply_gain(F.col("base"), F.col("gain"), F.col("low"), F.col("high"), F.col("gamma"),
                           GAIN_OFFSET, GAIN_OFFSET)
    return px.select("asset_id", "y", "x", value.alias("hdr"))
