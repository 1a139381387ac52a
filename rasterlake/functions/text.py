"""Text expressions: sizes, durations, paths, analyser output, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def format_size(size: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mb, F.format_string("%.1f KB", size / float(kb)))
        .when(size < gb, F.format_string("%.1f MB", size / float(mb)))
        .otherwise(F.format_string("%.2f GB", size / float(gb)))
    )


def format_duration(seconds: Column) -> Column:
    whole = F.floor(seconds)
    sec, minute = (whole % 60).cast("int"), (F.floor(whole / 60) % 60).cast("int")
    return (
        F.when(seconds < 1, "<1s")
        .when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(seconds / 60.0 + 0.5).cast("int"), sec))
        .otherwise(F.format_string("%dh %dm %ds", F.floor(seconds / 3600.0 + 0.5).cast("int"), minute, sec))
    )


def score(text: Column) -> Column:
    return F.when(F.lower(text) == "inf", F.lit(float("inf"))).otherwise(text.try_cast("double"))


def last_match(text: Column, pattern: str, group: int) -> Column:
    """The last match is the summary when every frame printed a line."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.try_element_at(found, F.lit(-1))


def _last_line(text: Column, label: str, total: str) -> Column:
    """What follows the label in the last line that has it and, behind it, the total."""
    low = F.lower(text)
    lines = F.filter(F.split(low, "\n"), lambda x: x.contains(label) & F.substring_index(x, label, -1).contains(f"{total}:"))
    return F.substring_index(F.try_element_at(lines, F.lit(-1)), label, -1)


def score_lines(text: Column) -> Column:
    """The last SSIM and the last PSNR line of an analyser's output, behind their labels."""
    return F.struct(_last_line(text, "ssim", "all").alias("ssim"), _last_line(text, "psnr", "average").alias("psnr"))


def _named(line: Column, name: str) -> Column:
    """The number given as `name: number`, wherever it stands among the others of a line."""
    said = F.ltrim(F.substring_index(F.concat(F.lit(" "), line), f"{name}:", -1))
    number = F.regexp_extract(said, "^([^ (),;\t\r]+)", 1)
    return F.when(line.contains(f"{name}:"), score(number))


def parse_scores(lines: Column) -> Column:
    """Scores of those two lines, given as a column of its own. The first number in brackets is the SSIM's dB."""
    ssim, psnr = lines["ssim"], lines["psnr"]
    behind = F.substring_index(ssim, "all:", -1)
    bracket = F.regexp_extract(behind, "[(]\\s*([^ )d]+)", 1)
    return F.struct(
        _named(ssim, "all").alias("ssim_all"),
        score(F.nullif(bracket, F.lit(""))).alias("ssim_db"),
        _named(psnr, "average").alias("psnr_avg"),
        _named(psnr, "min").alias("psnr_min"),
        _named(psnr, "max").alias("psnr_max"),
    )


def tail_chars(text: Column, n: int = 500) -> Column:
    return F.right(text, F.lit(n))


def value_digest(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 8)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "[.][^.]*$", "")


def output_path(path: Column, root: Column, out_dir: str | None, ext: str, preserve: bool) -> Column:
    """Flat target name, or the input's tree rebuilt below the output folder."""
    flat = F.concat(stem(path), F.lit(f".{ext.lower()}"))
    if not out_dir:
        return F.concat(directory(path), F.lit("/"), flat)
    base = F.concat(F.lit(f"{out_dir.rstrip('/')}/"), flat)
    if not preserve:
        return base
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    inside = F.coalesce(F.startswith(path, prefix), F.lit(False))
    rel_dir = directory(F.substr(path, F.length(prefix)))
    kept = F.concat(F.lit(out_dir.rstrip("/")), rel_dir, F.lit("/"), flat)
    return F.when(inside & ~path.contains("/../"), kept).otherwise(base)


def under_prefix(path: Column, folder: Column) -> Column:
    p, d = F.lower(path), F.lower(F.rtrim(folder, F.lit("/")))
    return F.coalesce((p == d) | F.startswith(p, F.concat(d, F.lit("/"))), F.lit(False))


def guess_space(description: Column) -> Column:
    d = F.lower(description)

    def has(*words):
        hit = d.contains(words[0])
        for word in words[1:]:
            hit = hit | d.contains(word)
        return hit

    return (
        F.when(has("srgb", "iec61966"), "sRGB")
        .when(has("adobergb", "adobe rgb"), "Adobe RGB")
        .when(has("display p3", "displayp3"), "Display P3")
        .when(has("dci-p3", "dci p3"), "DCI-P3")
        .when(has("prophoto", "romm"), "ProPhoto RGB")
        .when(has("rec.2020", "bt.2020", "rec2020"), "Rec.2020")
        .when(has("rec.2100", "bt.2100"), "Rec.2100")
        .when(has("colormatch"), "ColorMatch RGB")
    )


def color_info(primaries: Column, transfer: Column, matrix: Column, value_range: Column) -> Column:
    def part(label, value, *drop):
        known = value.isNotNull() & (F.trim(value) != "") & ~value.isin("unknown", *drop)
        return F.when(known, F.concat(F.lit(f"{label}="), value))

    joined = F.concat_ws(" / ", part("primaries", primaries), part("transfer", transfer),
                         part("matrix", matrix, "gbr"), part("range", value_range))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("(untagged)"))
