"""Scalar expressions for SQL users.

They are SQL functions with an expression body, so Catalyst inlines them: no
Python runs and predicates around them still push down.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rasterlake.functions.curves import HLG_A, HLG_B, HLG_C, PQ_C1, PQ_C2, PQ_C3, PQ_M1, PQ_M2
from rasterlake.functions.gain import GAIN_OFFSET
from rasterlake.functions.media import ALPHA_PREFIXES, PRIMARIES_TAG_ALIASES, TRANSFER_ALIASES


def _aliases(table: dict[str, str]) -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return f"coalesce(try_element_at(map({pairs}), lower(trim(token))), nullif(lower(trim(token)), ''))"


# signature -> SQL body
SQL_FUNCTIONS = {
    "has_alpha(pix_fmt string)": f"coalesce(lower(trim(pix_fmt)) rlike '^({'|'.join(ALPHA_PREFIXES)})', false)",
    "is_float(pix_fmt string)": "coalesce(contains(pix_fmt, 'f32') or contains(pix_fmt, 'f16'), false)",
    "norm_transfer(token string)": _aliases(TRANSFER_ALIASES),
    "norm_primaries(token string)": _aliases(PRIMARIES_TAG_ALIASES),
    "rational(txt string)":
        "coalesce(case when txt like '%/%' then try_divide(try_cast(split_part(txt, '/', 1) as double), "
        "try_cast(split_part(txt, '/', 2) as double)) else try_cast(txt as double) end, 0D)",
    "value_digest(v string)": "substring(sha2(v, 256), 1, 8)",
    "format_size(size bigint)":
        "case when size < 1024 then concat(size, ' B') when size < 1048576 then format_string('%.1f KB', size / 1024D) "
        "when size < 1073741824 then format_string('%.1f MB', size / 1048576D) else format_string('%.2f GB', size / 1073741824D) end",
    "srgb_to_linear(v double)":
        "sign(v) * case when abs(v) < 0.04045D then abs(v) / 12.92D else power((abs(v) + 0.055D) / 1.055D, 2.4D) end",
    "pq_to_linear(v double)":
        f"case when v <= 0 then 0D else power(greatest(power(v, {1 / PQ_M2!r}D) - {PQ_C1!r}D, 0D) / "
        f"({PQ_C2!r}D - {PQ_C3!r}D * power(v, {1 / PQ_M2!r}D)), {1 / PQ_M1!r}D) end",
    "hlg_to_linear(v double)":
        f"case when v <= 0.5D then v * v / 3D else (exp((v - {HLG_C!r}D) / {HLG_A!r}D) + {HLG_B!r}D) / 12D end",
    "log2_gain(hdr double, sdr double)":
        f"case when sdr + {GAIN_OFFSET!r}D <= 0 then 0D else log2(greatest(try_divide(hdr + {GAIN_OFFSET!r}D, sdr + {GAIN_OFFSET!r}D), 1D)) end",
    "luma709(r double, g double, b double)": "0.2126D * r + 0.7152D * g + 0.0722D * b",
    "luma2020(r double, g double, b double)": "0.2627D * r + 0.6780D * g + 0.0593D * b",
}


def register_functions(spark: SparkSession, prefix: str = "rl_") -> list[str]:
    """Publish the functions for this session and return their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{signature} return {body}")
    return [prefix + s.split("(")[0] for s in SQL_FUNCTIONS]
