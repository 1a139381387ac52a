"""Order-insensitive comparison of two pandas results."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _norm(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _norm(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, _norm(v)) for k, v in value.asDict().items()))
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return None if np.isnan(value) else float(value) + 0.0
    return str(value)


def _rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = []
    for c in sorted(got.columns):
        g, w = got[c].dtype.kind, want[c].dtype.kind
        if g != w and {g, w} - {"O", "f", "i", "b", "U"}:
            kinds.append(f"{c}: {got[c].dtype} vs {want[c].dtype}")
        elif {g, w} == {"i", "f"} and not (got[c].isna().any() or want[c].isna().any()):
            kinds.append(f"{c}: {got[c].dtype} vs {want[c].dtype}")
        elif g == w == "i" and got[c].dtype != want[c].dtype:
            kinds.append(f"{c}: {got[c].dtype} vs {want[c].dtype}")
    left, right = _rows(got), _rows(want)
    diff = [(a, b) for a, b in zip(left, right) if a != b]
    if diff:
        return f"{len(diff)} rows differ, first {sorted(got.columns)}: {diff[0]} {kinds}"
    return f"types {kinds}" if kinds else ""
