"""Derived test views over the given parquet tables, as Spark DataFrames.

Every view keeps all rows of its source; `sqlviews` holds the same views as
DuckDB SQL.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.textkit import slices
from rasterlake.operators import ordered, tiles
from rasterlake.operators.pixels import split_frames, unpack_bytes, unpack_pixels
from rasterlake.operators.transform import PIECE

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
FRAME = 24  # samples per frame: 64 samples make two whole frames and a short tail


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def rasters(self) -> DataFrame:
        """One row per 8x8 image: asset_id, codes (64 values of 0..255)."""
        code = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(
            F.lit(255), F.floor((e.cast("double") + 0.6) * 200.0))).cast("int"))
        return self.embeddings.select(F.col("vec_id").alias("asset_id"), code.alias("codes"))

    @cached_property
    def px8(self) -> DataFrame:
        return unpack_pixels(self.rasters, "codes", 8)

    @cached_property
    def px8f(self) -> DataFrame:
        """Frames of 24 samples with a coarser rendition; frame 0 is identical."""
        step = F.col("frame") * 4 + 1
        return split_frames(self.rasters, "codes", FRAME, 8).withColumn(
            "code2", F.least(F.lit(255), F.floor(F.col("code") / step) * step).cast("int"))

    @property
    def ref(self) -> DataFrame:
        return self.px8f.drop("code2")

    @property
    def enc(self) -> DataFrame:
        return self.px8f.drop("code").withColumnRenamed("code2", "code")

    def _lines(self, codes, bits: int = 8) -> DataFrame:
        """The frames of px8f as tiles of one line each, of the given codes (an array of eight by line)."""
        y = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("line")
        lines = self.rasters.select("asset_id", y, "codes").select(
            "asset_id", F.floor(F.col("line") / 3).cast("int").alias("frame"), (F.col("line") % 3).cast("int").alias("y0"), F.lit(0).alias("x0"),
            F.lit(8).alias("w"), F.lit(1).alias("h"), F.slice("codes", F.col("line") * 8 + 1, F.lit(8)).alias("codes"))
        return tiles.from_arrays(lines.withColumn("codes", codes), "codes", bits=bits)

    @staticmethod
    def _coarser(code):
        step = F.col("frame") * 4 + 1
        return F.least(F.lit(255), F.floor(code / step) * step).cast("int")

    @cached_property
    def ref_tiles(self) -> DataFrame:
        return self._lines(F.col("codes"))

    @cached_property
    def enc_tiles(self) -> DataFrame:
        """The rendition of px8f."""
        return self._lines(F.transform("codes", self._coarser))

    @cached_property
    def wide_tiles(self) -> tuple[DataFrame, DataFrame]:
        """Both renditions with 16 bits: 257 times the code."""
        return (self._lines(F.transform("codes", lambda c: c * 257), 16), self._lines(F.transform("codes", lambda c: self._coarser(c) * 257), 16))

    @cached_property
    def rgb_tiles(self) -> DataFrame:
        """The images of pxrgb as two tiles each: five lines and three."""
        def shifted(by):
            return F.transform("codes", lambda c, i: F.get("codes", ((i + by) % F.size("codes")).cast("int")))

        whole = self.rasters.select("asset_id", F.flatten(F.transform(
            F.arrays_zip(F.col("codes").alias("r"), shifted(21).alias("g"), shifted(42).alias("b")), lambda p: F.array(p["r"], p["g"], p["b"]))).alias("codes"))
        part = F.explode(F.array(F.struct(F.lit(0).alias("y0"), F.lit(5).alias("h")), F.struct(F.lit(5).alias("y0"), F.lit(3).alias("h")))).alias("p")
        cut = whole.select("asset_id", part, "codes").select(
            "asset_id", F.lit(0).alias("frame"), "p.y0", F.lit(0).alias("x0"), F.lit(8).alias("w"), "p.h",
            F.slice("codes", F.col("p.y0") * 24 + 1, F.col("p.h") * 24).alias("codes"))
        return tiles.from_arrays(cut, "codes", 3)

    @cached_property
    def mixed_sizes(self) -> DataFrame:
        """Sizes of three kinds of image and of their gain grids."""
        def pick(*values):
            kind = F.col("asset_id") % 3
            return F.when(kind == 0, values[0]).when(kind == 1, values[1]).otherwise(values[2])

        return self.rasters.select("asset_id", pick(8, 8, 5).alias("base_w"), pick(8, 6, 7).alias("base_h"), pick(4, 3, 5).alias("gain_w"), pick(4, 2, 3).alias("gain_h"))

    @cached_property
    def mixed_tiles(self) -> DataFrame:
        """The top left corner of each image in the size of mixed_sizes, in tiles of three lines."""
        y0 = F.explode(F.array(F.lit(0), F.lit(3), F.lit(6))).alias("y0")
        cut = self.rasters.join(self.mixed_sizes, "asset_id").select("asset_id", y0, "codes", "base_w", "base_h").where("y0 < base_h")
        cut = cut.withColumns({"h": F.least(F.lit(3), F.col("base_h") - F.col("y0")), "w": F.col("base_w"), "frame": F.lit(0), "x0": F.lit(0)})
        lines = F.flatten(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.slice("codes", (F.col("y0") + i) * 8 + 1, F.col("w"))))
        return tiles.from_arrays(cut.withColumn("codes", lines), "codes")

    @cached_property
    def square_tiles(self) -> DataFrame:
        """The images of px8 as four tiles of four by four; tile is their number."""
        n = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tile")
        place = self.rasters.select("asset_id", n, "codes").withColumns({"y0": (F.floor(F.col("tile") / 2) * 4).cast("int"), "x0": (F.col("tile") % 2 * 4).cast("int")})
        cut = place.withColumn("codes", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("codes", (F.col("y0") + i) * 8 + F.col("x0") + 1, F.lit(4)))))
        return tiles.from_arrays(cut.withColumns({"frame": F.lit(0), "w": F.lit(4), "h": F.lit(4)}), "codes")

    @cached_property
    def buffers(self) -> DataFrame:
        """Raw bytes of each document as an 8-bit buffer, and a rendition in
        which some letters are replaced by their neighbours."""
        docs = self.documents.select("doc_id", "text")
        return docs.select(
            F.col("doc_id").alias("asset_id"), F.lit(0).alias("part"), F.encode("text", "UTF-8").alias("buf"),
            F.encode(F.translate("text", "abcdefgh", "bcdefghi"), "UTF-8").alias("buf2"))

    @cached_property
    def text_rgb_tiles(self) -> DataFrame:
        """The bytes of each document as R of an image 64 wide, its complement as G, its half as B; the last line may be short."""
        def run(batches):
            for batch in (piece for whole in batches for piece in slices(whole, "buf", PIECE)):
                rows = []
                for doc, raw in zip(batch.column("asset_id").to_pylist(), batch.column("buf").to_pylist(), strict=True):
                    r = np.frombuffer(raw or b"", np.uint8)
                    px, body = np.stack([r, 255 - r, r // 2], 1), len(r) // 64
                    rows += [(doc, y, 64, min(4096, body - y), px[y * 64 : min(y + 4096, body) * 64].tobytes()) for y in range(0, body, 4096)]
                    if len(r) % 64:
                        rows.append((doc, body, len(r) % 64, 1, px[body * 64 :].tobytes()))
                asset, y0, w, h, buf = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asset, pa.int64()), *(pa.array(x, pa.int32()) for x in (y0, w, h)), pa.array(buf, pa.binary())], names=["asset_id", "y0", "w", "h", "buf"])

        cut = self.buffers.select("asset_id", "buf").mapInArrow(run, "asset_id bigint, y0 int, w int, h int, buf binary")
        return cut.withColumns({"frame": F.lit(0), "x0": F.lit(0), "channels": F.lit(3), "bits": F.lit(8)})

    @cached_property
    def text_px(self) -> DataFrame:
        return unpack_bytes(self.buffers, "buf", 64)

    @cached_property
    def pxrgb(self) -> DataFrame:
        """8x8 RGB images: each channel is the raster shifted by a third."""
        spread = self.rasters.select("asset_id", "codes", F.posexplode("codes").alias("pos", "r"))

        def shifted(by):
            return F.element_at("codes", ((F.col("pos") + by) % F.size("codes") + 1).cast("int"))

        return spread.select(
            "asset_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
            "r", shifted(21).alias("g"), shifted(42).alias("b"))

    @cached_property
    def gain(self) -> DataFrame:
        v = F.col("code") / 255.0
        return self.px8.select("asset_id", "y", "x", v.alias("sdr"), F.least(F.lit(8.0), v * v * 6.0 + 0.01).alias("hdr"))

    @cached_property
    def gmeta(self) -> DataFrame:
        top = F.array_max("codes") / 64.0
        extra = F.when(F.col("asset_id") % 5 == 0, 0.5).otherwise(0.0)
        return self.rasters.select(
            "asset_id", top.alias("iso_max"), F.lit(0.0).alias("iso_min"), (top + extra).alias("xmp_max"),
            F.lit(0.0).alias("xmp_min"), F.when(F.col("asset_id") % 3 == 0, 0.0).otherwise(2.0).alias("iso_cap"),
            F.lit(2.3).alias("xmp_cap"), (F.col("asset_id") % 7 != 0).alias("has_xmp"),
            F.lit(1.0).alias("iso_gamma"), F.when(F.col("asset_id") % 4 == 0, 0.0).otherwise(1.5).alias("xmp_gamma"),
            F.lit(0.015625).alias("iso_offset_sdr"), F.lit(0.015625).alias("iso_offset_hdr"),
            F.lit(0.01).alias("xmp_offset_sdr"), F.lit(0.02).alias("xmp_offset_hdr"),
            (F.col("asset_id") % 11 == 0).alias("base_is_hdr"))

    @cached_property
    def mats(self) -> DataFrame:
        """A measured colorant matrix per asset: the sRGB one plus jitter from
        the mean of every ninth sample."""
        base = (0.4361, 0.3851, 0.1431, 0.2225, 0.7169, 0.0606, 0.0139, 0.0971, 0.7141)
        scale = F.when(F.col("asset_id") % 2 == 0, 1e-5).otherwise(1e-3)

        def cell(i):
            mine = F.filter("codes", lambda v, p: p % 9 == i)
            mean = F.aggregate(mine, F.lit(0), lambda a, v: a + v) / F.size(mine)
            return F.lit(base[i]) + (mean - 120.0) * scale

        return self.rasters.select("asset_id", *[cell(i).alias(f"m{i}") for i in range(9)])

    @cached_property
    def assets(self) -> DataFrame:
        k = "p_partkey"
        return self.part.selectExpr(
            f"{k} asset_id",
            f"case {k} % 8 when 0 then 'jpg' when 1 then 'png' when 2 then 'webp' when 3 then 'avif' when 4 then 'jxl'"
            " when 5 then 'heic' when 6 then 'tiff' else 'xyz' end format",
            "cast(320 + p_size * 16 as int) width", f"cast(200 + ({k} % 9) * 24 as int) height",
            f"cast({k} % 4 - 1 as int) * 90 rotation", f"cast(({k} % 5) * 2 as int) crop_x",
            f"case {k} % 9 when 0 then 'yuv420p' when 1 then 'yuv420p10le' when 2 then 'rgb24' when 3 then 'rgb48le'"
            " when 4 then 'rgba64le' when 5 then 'gray16le' when 6 then 'gbrpf32le' when 7 then 'ya8' else 'weird' end pix_fmt",
            f"case {k} % 7 when 0 then 'bt709' when 1 then 'bt2020' when 2 then 'smpte432' when 3 then 'p3'"
            " when 4 then 'unspecified' when 5 then 'smpte431' else null end primaries",
            f"case {k} % 5 when 0 then 'iec61966-2-1' when 1 then 'smpte2084' when 2 then 'arib-std-b67'"
            " when 3 then 'bt709' else 'linear' end transfer",
            f"case {k} % 6 when 0 then 'bt709' when 1 then 'bt2020nc' when 2 then 'gbr' when 3 then 'ipt' else null end matrix",
            "cast(p_retailprice * 1000 as bigint) size_bytes",
            f"{k} % 3 = 0 lossless", f"cast(p_size * 40 as double) peak_nits", f"cast({k} % 101 as int) quality",
            f"{k} % 4 = 1 has_icc", "p_brand brand",
        )

    @cached_property
    def probe(self) -> DataFrame:
        return self.assets.selectExpr(
            "asset_id",
            """concat('{"format":{"format_name":"', format, '"},"streams":[{"codec_type":"audio","index":0},'
            , '{"codec_type":"video","index":1,"width":', width, ',"height":', height, ',"pix_fmt":"', pix_fmt
            , '","nb_frames":', asset_id % 5, ',"side_data_list":[{"side_data_type":"ICC Profile","crop_left":7},{"side_data_type":"Frame Cropping","crop_left":', crop_x
            , '}]},{"codec_type":"video","index":2,"width":64,"height":64,"nb_frames":', asset_id % 3
            , '}],"frames":[{"side_data_list":[{"side_data_type":"EXIF metadata","rotation":90,"crop_left":3},{"side_data_type":"3x3 displaymatrix","rotation":', rotation, '},{"'
            , case when asset_id % 3 = 0 then 'max_luminance' else 'max_content' end, '":"', asset_id * 10000, '/10000"}]}],'
            , '"stream_groups":[{"type":"', case when asset_id % 2 = 0 then 'Tile Grid' else 'other' end
            , '","components":[{"nb_tiles":', asset_id % 12, ',"width":', width * 2, ',"height":', height * 2, '}]}]}') js""")

    @cached_property
    def paths(self) -> DataFrame:
        return self.pages.selectExpr(
            "page_id asset_id",
            "concat('/', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '.', "
            "case page_id % 7 when 0 then 'jpg' when 1 then 'png' when 2 then 'webp' when 3 then 'avif' "
            "when 4 then 'jxl' when 5 then 'heic' else 'mp4' end) path",
            "concat('img', page_id % 9) stem",
            "case page_id % 7 when 0 then 'jpg' when 1 then 'png' when 2 then 'webp' when 3 then 'avif' "
            "when 4 then 'jxl' when 5 then 'heic' else 'mp4' end ext",
            "cast(length(html) as bigint) size",
        )

    @cached_property
    def tags(self) -> DataFrame:
        return self.tags_with_make.drop("make")

    @cached_property
    def tags_with_make(self) -> DataFrame:
        return self.part.selectExpr(
            "p_partkey asset_id", "p_brand make",
            "stack(10, 'IFD0', 'Make', p_brand, 'IFD0', 'Model', p_name, 'ExifIFD', 'ISO', cast(p_size as string), "
            "'ExifIFD', 'DateTimeOriginal', concat('2024-01-', p_size), 'ExifIFD', 'FocalLength', cast(p_size % 3 as string), "
            "'ExifIFD', 'FNumber', if(p_size % 4 = 0, 'undef (0/0)', cast(p_size % 4 as string)), 'ExifIFD', 'ExposureTime', cast(p_size % 2 as string), "
            "'GPS', 'GPSLatitude', cast(p_size * 2 as string), 'XMP', 'Label', p_type, "
            "'ICC_Profile', 'ProfileDescription', p_type) as (grp, tag, value)")

    @cached_property
    def product_tags(self) -> DataFrame:
        """What the product holds: some tags lost, some changed, one added."""
        kept = self.tags.selectExpr(
            "asset_id", "grp",
            "case when tag in ('ISO', 'FocalLength', 'FNumber', 'ExposureTime') and asset_id % 3 = 0 then concat('Legacy', tag) else tag end tag",
            "case when tag = 'GPSLatitude' and asset_id % 5 = 0 then cast(cast(value as int) + 1 as string) else value end value")
        return kept.unionByName(self.part.selectExpr("p_partkey asset_id", "'XMP' grp", "'Tool' tag", "p_name value"))

    @cached_property
    def ledger(self) -> DataFrame:
        return self.tags.selectExpr(
            "asset_id", "grp", "tag", "value",
            "case when grp = 'GPS' then 'position' when grp = 'XMP' then 'text' when tag = 'ISO' then 'exposure' else 'identity' end cls",
            "case asset_id % 4 when 0 then 'carry_verified' when 1 then 'carry_gap' when 2 then 'policy_discarded' else 'unaudited' end disposition",
            "case asset_id % 3 when 0 then 'verified' when 1 then 'source_inferred' else 'pending' end level")

    @cached_property
    def jobs(self) -> DataFrame:
        return job_events(self.events)

    @cached_property
    def progress(self) -> DataFrame:
        return progress_lines(self.jobs)

    @cached_property
    def docs(self) -> DataFrame:
        return self.jobs.selectExpr(
            "event_id",
            "concat('n:1 SSIM Y:0.9 All:0.91 (10.1)', chr(10), 'SSIM All:0.', 100 + k, ' (', k, '.5)', chr(10), "
            "'PSNR y:1.0 average:', case when k % 10 = 0 then 'inf' else concat(k, '.25') end, ' min:1.5 max:99.0') txt",
            "concat(k * 10000, '/', case when k % 7 = 0 then 0 else 10000 end) rat",
            "cast(k as bigint) * k * k * k * 100 bytes", "k")

    @cached_property
    def bench(self) -> DataFrame:
        """Compressor runs: every order line is one run of case and arm."""
        return self.lineitem.selectExpr(
            "l_partkey case_id", "l_linenumber arm_id", "l_orderkey * 100000 + l_suppkey run_id",
            "cast(1000 + l_quantity * 10 as bigint) baseline_bytes",
            "cast(900 + (l_partkey * 7 + l_suppkey * 13) % 300 as bigint) output_bytes",
            "case (l_partkey + l_suppkey) % 11 when 0 then 'timeout' when 1 then 'fail' when 2 then 'skip' else 'ok' end status",
            "(l_partkey + l_suppkey) % 17 <> 3 pixel_equal", "l_suppkey % 13 = 5 chunk_loss", "l_orderkey % 19 <> 7 decode_ok",
            "(l_partkey * 31 + l_suppkey + l_orderkey) % 500 + 1 time_ms", "cast(l_quantity as bigint) * 4096 pixels")

    @cached_property
    def boxes(self) -> DataFrame:
        """Box chains: one per conversation, a box per turn; some are broken."""
        turns = self.conversations.selectExpr(
            "conv_id asset_id", "turn seq", "role type", "cast(length(text) + 8 as bigint) size")
        summed = ordered.running_sum(turns, ["asset_id"], [F.col("seq")], ordered.block("seq"), F.col("size"), "upto")
        shift = F.when((F.col("asset_id") % 10 == 3) & (F.col("seq") == 2), 1).otherwise(0)
        return summed.select("asset_id", "seq", "type", "size", (F.col("upto") - F.col("size") + shift).alias("off"))

    @cached_property
    def box_lengths(self) -> DataFrame:
        return self.conversations.selectExpr("conv_id", "length(text) + 8 size").groupBy(
            F.col("conv_id").alias("asset_id")).agg((F.sum("size") + F.when(F.col("asset_id") % 7 == 4, 5).otherwise(0)).alias("file_len"))

    @cached_property
    def png_chunks(self) -> DataFrame:
        return self.conversations.selectExpr(
            "conv_id asset_id", "turn seq",
            "case when turn = 0 and conv_id % 13 <> 0 then 'IHDR' when turn > 2 and length(text) % 3 = 0 then 'IEND' else 'IDAT' end type",
            "case when turn = 0 then 13 + case when conv_id % 5 = 1 then 1 else 0 end "
            "when turn > 2 and length(text) % 3 = 0 then 0 else length(text) end length",
            "cast(case conv_id % 3 when 0 then 8 when 1 then 16 else 4 end as int) bit_depth",
            "cast(case conv_id % 4 when 0 then 2 when 1 then 3 else 6 end as int) color_type")

    @cached_property
    def options(self) -> DataFrame:
        """Layered settings: every order sets one key of its customer's profile."""
        return self.orders.selectExpr(
            "o_custkey owner", "cast(o_orderkey % 5 + 1 as int) priority", "concat('key', o_orderkey % 4) k",
            "case when o_orderkey % 3 = 0 then null else o_orderpriority end v", "o_orderkey ord")

    @cached_property
    def strip_options(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_custkey owner", "c_custkey % 2 = 0 gps", "c_custkey % 3 = 0 time", "c_custkey % 5 = 0 camera",
            "c_custkey % 7 = 0 exif", "c_custkey % 11 < 5 xmp",
            "case c_custkey % 4 when 0 then 'StripAll' else 'Keep' end mode")

    @cached_property
    def cases(self) -> DataFrame:
        """Test cases: every part is a case with a value on three axes."""
        return self.part.selectExpr("p_partkey case_id", "stack(3, 'brand', p_brand, 'type', p_type, 'size', cast(p_size as string)) as (axis, val)")

    @cached_property
    def cases_wide(self) -> DataFrame:
        return self.part.selectExpr("p_partkey case_id", "p_brand brand", "p_type type", "cast(p_size as string) size")

    @cached_property
    def cache(self) -> DataFrame:
        """Probe cache: most pages, some entries old or of another version."""
        return self.pages.selectExpr(
            "case when page_id % 4 = 1 then concat(url, '.old') else url end path", "page_id % 50 + case when page_id % 6 = 0 then 1 else 0 end mtime", "html json",
            "timestamp'2024-01-03 00:00:00' - make_dt_interval(cast(page_id % 40 as int)) probed_at")

    @cached_property
    def probe_inputs(self) -> DataFrame:
        return self.pages.selectExpr("page_id asset_id", "url path", "page_id % 50 mtime")

    def _stream(self, name: str) -> DataFrame:
        """A table as a stream, be it one file or a folder of them: a stream takes no file by its name, but a pattern that fits it alone."""
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(f"{self.sf_dir}/{name}.[p]arquet")

    @property
    def event_stream(self) -> DataFrame:
        return job_events(self._stream("events"))

    @property
    def page_stream(self) -> DataFrame:
        return self._stream("pages")


def job_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "user_id item_id", "cast(ts as timestamp) ts", "event_type", "value",
        "cast(get_json_object(props, '$.k') as int) k",
    ).selectExpr(
        "event_id", "item_id", "ts", "value", "k", "cast(item_id % 3 as int) batch",
        "case event_type when 'signup' then 'pending' when 'view' then 'processing' when 'click' then concat('processing ', k, '%') "
        "when 'purchase' then case when k % 10 = 0 then 'completed (degraded)' else 'completed' end "
        "else case k % 10 when 1 then 'stopped' when 2 then 'deleted' else concat('failed: ', k) end end status",
        "case event_type when 'purchase' then case when k % 10 = 5 then 1 else 0 end when 'error' then k else null end exit_code")


def progress_lines(jobs: DataFrame) -> DataFrame:
    return jobs.selectExpr(
        "event_id", "item_id", "ts",
        "case event_id % 3 when 0 then concat('frame=', k) when 1 then concat('stream_0_0_q=', k) else concat('Input #', k, ' = file') end line",
        "event_id % 3 line_kind")
