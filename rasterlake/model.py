"""Schemas and fixed dimension tables.

Every dimension here is a constant of a few dozen rows, so broadcasting it is
bounded by construction; nothing derived from user data is ever broadcast by
hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions.chromaticities import PRIMARIES, PRIMARIES_ALIASES
from rasterlake.functions.matrices import colorants_d50, rgb_to_xyz, xy_of_columns

# --- fixed values: container colour capabilities -----------------------------
# format: (arbitrary ICC, CICP, ICC generated from CICP, max bit depth,
#          RGB native, HDR, unlabelled means sRGB, ICC and CICP together,
#          gain map)
CONTAINER_CAPS = {
    "png": (True, True, True, 16, True, True, True, True, False),
    "apng": (True, True, True, 16, True, True, True, True, False),
    "jpg": (True, False, True, 8, False, False, True, False, True),
    "jpeg": (True, False, True, 8, False, False, True, False, True),
    "jpegli": (True, False, True, 8, False, False, True, False, True),
    "tiff": (True, False, True, 16, True, False, False, False, False),
    "tif": (True, False, True, 16, True, False, False, False, False),
    "webp": (True, False, True, 8, False, False, True, False, False),
    "jxl": (True, True, True, 32, True, True, False, False, True),
    "avif": (True, True, True, 12, False, True, False, True, True),
    "heic": (False, False, False, 8, False, False, False, False, False),
    "heif": (False, False, False, 8, False, False, False, False, False),
    "jxr": (False, False, False, 16, True, False, False, False, False),
    "gif": (False, False, False, 8, True, False, False, False, False),
    "webm": (False, False, False, 8, False, False, False, False, False),
    "ppm": (False, False, False, 16, True, False, False, False, False),
}
CAPS_FIELDS = (
    "can_icc", "can_cicp", "can_icc_from_cicp", "max_bit_depth", "rgb_native",
    "can_hdr", "unlabeled_srgb", "icc_and_cicp", "gain_map",
)
# Outlets that accept only these named colour spaces instead of any CICP pair.
ENUM_OUTLET_SPACES = {"jxl": ("sRGB", "DisplayP3", "Rec2100PQ", "Rec2100HLG")}
# --- fixed values: format names and the extensions they enable ---------------
IMAGE_EXTENSIONS = {
    "PNG": ("png",),
    "JPEG": ("jpg", "jpeg", "jpe", "jfif"),
    "JPEG XL": ("jxl",),
    "JPEG XR": ("jxr", "wdp", "hdp"),
    "WebP": ("webp",),
    "AVIF": ("avif",),
    "TIFF": ("tiff", "tif"),
    "HEIC": ("heic", "heif"),
    "DNG": ("dng",),
    "BMP": ("bmp",),
    "GIF": ("gif",),
    "RAW-Canon": ("cr2", "cr3", "crw"),
    "RAW-Nikon": ("nef", "nrw"),
    "RAW-Sony": ("arw", "srf", "sr2"),
    "RAW-Fujifilm": ("raf",),
    "RAW-Olympus": ("orf",),
    "RAW-Panasonic": ("rw2", "rwl"),
    "RAW-Pentax": ("pef",),
    "RAW-Others": ("3fr", "srw", "mrw", "x3f", "erf", "kdc", "dcr", "mef", "mos", "iiq", "bay", "raw"),
}
VIDEO_EXTENSIONS = {
    "MP4": ("mp4", "m4v"),
    "MOV": ("mov",),
    "MKV": ("mkv",),
    "AVI": ("avi",),
    "WebM": ("webm",),
    "WMV": ("wmv",),
    "FLV": ("flv",),
}
DECODE_ONLY_FORMATS = ("heic",)
# --- fixed values: named profile -> (primaries, transfer, approximated) ------
PROFILE_SEMANTICS = {
    "sRGB": ("bt709", "iec61966-2-1", False),
    "Adobe RGB": ("bt709", "bt709", True),
    "ColorMatch RGB": ("bt709", "bt709", True),
    "Display P3": ("smpte432", "iec61966-2-1", False),
    "DCI-P3": ("smpte431", "bt709", False),
    "Rec.2020": ("bt2020", "bt709", False),
    "Rec.2100": ("bt2020", "smpte2084", False),
    "ProPhoto RGB": ("bt709", "bt709", True),
}
# --- fixed values: tags removed by the camera privacy switch -----------------
CAMERA_TAGS = (
    "Make", "Model", "LensMake", "LensModel", "LensSerialNumber",
    "FocalLength", "FocalLengthIn35mmFormat", "FNumber", "ApertureValue",
    "MaxApertureValue", "ExposureTime", "ShutterSpeedValue", "ISO",
    "ISOSpeedRatings", "Flash", "WhiteBalance", "ExposureProgram",
    "ExposureMode", "ExposureBiasValue", "MeteringMode", "SceneCaptureType",
    "LightSource", "SensingMethod", "CameraOwnerName", "BodySerialNumber",
)
# --- fixed values: capture fields restored from the original -----------------
CAPTURE_TIME_TAGS = (
    "DateTimeOriginal", "CreateDate", "ModifyDate", "SubSecTime",
    "SubSecTimeOriginal", "SubSecTimeDigitized", "OffsetTime",
    "OffsetTimeOriginal", "OffsetTimeDigitized",
)
CAPTURE_CAMERA_TAGS = (
    "Make", "Model", "LensModel", "LensMake", "LensSerialNumber", "LensInfo",
    "LensSpecification", "MaxApertureValue",
)
CAPTURE_TAGS = (
    "ExposureProgram", "MeteringMode", "Flash", "ExposureMode",
    "SceneCaptureType", "CustomRendered", "ShutterSpeedValue", "ApertureValue",
    "BrightnessValue", "ExposureCompensation", "SubjectDistance",
    "LightSource", "WhiteBalance", "DigitalZoomRatio",
    "FocalLengthIn35mmFormat", "SubjectDistanceRange", "SensingMethod",
    "FileSource", "SceneType", "FocalPlaneXResolution",
    "FocalPlaneYResolution", "FocalPlaneResolutionUnit", "Artist",
    "Copyright", "ImageDescription", "UserComment", "Rating", "XPKeywords",
    "XPComment", "XPTitle", "XPSubject", "XPAuthor",
)

# --- schemas -----------------------------------------------------------------
JOB_LOG_SCHEMA = T.StructType([
    T.StructField("t", T.TimestampType()),
    T.StructField("l", T.StringType()),
    T.StructField("c", T.StringType()),
    T.StructField("m", T.StringType()),
    T.StructField("f", T.StringType()),
    T.StructField("p", T.IntegerType()),
    T.StructField("tot", T.IntegerType()),
    T.StructField("dur", T.DoubleType()),
    T.StructField("code", T.IntegerType()),
])
LEDGER_FIELDS = (
    "file", "make", "model", "group", "tag", "value", "value_sha8", "cls",
    "carrier", "map", "reader", "apply", "disposition", "reason", "evidence",
    "level", "rule", "b_recoverable",
)
LEDGER_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in LEDGER_FIELDS])
MATRIX_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in ("src", "dst", "status")]
    + [T.StructField("max_row_sum_dev", T.DoubleType())]
    + [T.StructField(f"m{r}{c}", T.DoubleType()) for r in range(3) for c in range(3)]
)
BENCH_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("arm_id", T.StringType()),
    T.StructField("input_bytes", T.LongType()),
    T.StructField("baseline_l9_bytes", T.LongType()),
    T.StructField("output_bytes", T.LongType()),
    T.StructField("ratio_vs_l9", T.DoubleType()),
    T.StructField("pct_saved_vs_l9", T.DoubleType()),
    T.StructField("pixel_equal", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("time_ms", T.LongType()),
    T.StructField("decode_ffmpeg", T.BooleanType()),
    T.StructField("decode_pillow", T.BooleanType()),
    T.StructField("chunk_loss", T.ArrayType(T.StringType())),
    T.StructField("chunk_gain", T.ArrayType(T.StringType())),
    T.StructField("corrupt", T.BooleanType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("notes", T.StringType()),
])
_SIDE = T.StructType([
    T.StructField("side_data_type", T.StringType()),
    T.StructField("rotation", T.IntegerType()),
    T.StructField("crop_left", T.IntegerType()),
    T.StructField("crop_right", T.IntegerType()),
    T.StructField("crop_top", T.IntegerType()),
    T.StructField("crop_bottom", T.IntegerType()),
    T.StructField("max_content", T.StringType()),
    T.StructField("max_luminance", T.StringType()),
])
_STREAM = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("codec_type", T.StringType()),
    T.StructField("codec_name", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("pix_fmt", T.StringType()),
    T.StructField("nb_frames", T.IntegerType()),
    T.StructField("color_primaries", T.StringType()),
    T.StructField("color_transfer", T.StringType()),
    T.StructField("color_space", T.StringType()),
    T.StructField("color_range", T.StringType()),
    T.StructField("side_data_list", T.ArrayType(_SIDE)),
])
_GROUP = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("components", T.ArrayType(T.StructType([
        T.StructField("nb_tiles", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]))),
])
PROBE_SCHEMA = T.StructType([
    T.StructField("format", T.StructType([T.StructField("format_name", T.StringType())])),
    T.StructField("streams", T.ArrayType(_STREAM)),
    T.StructField("frames", T.ArrayType(T.StructType([
        T.StructField("side_data_list", T.ArrayType(_SIDE)),
    ]))),
    T.StructField("stream_groups", T.ArrayType(_GROUP)),
])


# --- dimension DataFrames ----------------------------------------------------
def _literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def constant_table(spark: SparkSession, rows, names) -> DataFrame:
    """A fixed table as an inline relation: no job, and its size is known to
    the optimiser exactly."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {values} as t({', '.join(names)})")


def primaries_dim(spark: SparkSession) -> DataFrame:
    """alias -> token, RGB->XYZ matrix, D50 colorants and D50 primaries."""
    rows = []
    for alias, token in {**{t: t for t in PRIMARIES}, **PRIMARIES_ALIASES}.items():
        r, g, b, w = PRIMARIES[token]
        d50 = colorants_d50(r, g, b, w)
        rows.append((alias, token, [*r, *g, *b, *w], rgb_to_xyz(r, g, b, w), d50, xy_of_columns(d50)))
    return constant_table(spark, rows, ("alias", "token", "xy", "to_xyz", "d50", "xy_d50"))


def caps_map() -> Column:
    """format -> capability record, as a constant map."""
    entries = [
        f"{_literal(k)}, named_struct(" + ", ".join(f"'{f}', {_literal(x)}" for f, x in zip(CAPS_FIELDS, v)) + ")"
        for k, v in CONTAINER_CAPS.items()]
    return F.expr("map(" + ", ".join(entries) + ")")


def extension_dim(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(name, ext) for name, exts in table.items() for ext in exts]
    return constant_table(spark, rows, ("format_name", "ext"))


def profile_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in PROFILE_SEMANTICS.items()]
    return constant_table(spark, rows, ("profile", "profile_primaries", "profile_transfer", "approximated"))
