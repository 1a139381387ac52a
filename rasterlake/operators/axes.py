"""Test-parameter axes and coverage of their values.

A case table is long: case_id, axis, val. The values of an axis are a small
vocabulary; cases may be very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def axis_summary(cases: DataFrame) -> DataFrame:
    """Values and case rows per axis; two combining steps instead of a distinct
    count, so a hot axis is counted where its rows lie."""
    per_value = cases.groupBy("axis", "val").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("axis").agg(F.count("val").alias("n_values"), F.sum("n").alias("n_rows"))


def extension_union(image: DataFrame, video: DataFrame) -> DataFrame:
    return image.select("ext").union(video.select("ext")).distinct()


def _values(cases: DataFrame, axes: list[str]) -> DataFrame:
    """One row per value of the chosen axes."""
    return cases.where(F.col("axis").isin(*axes)).select("axis", "val").distinct()


def cartesian_cases(cases: DataFrame, axes: list[str]) -> DataFrame:
    """Full product of the chosen axes, the feature itself.

    Rows start as the first axis's values, spread over tasks; each further
    axis is a generator over its short list, a scalar subquery, so no join is made.
    """
    values = _values(cases, axes)
    product = values.where(F.col("axis") == axes[0]).select(F.col("val").alias(axes[0]))
    for axis in axes[1:]:
        listed = values.where(F.col("axis") == axis).agg(F.collect_list("val")).scalar()
        product = product.withColumn(axis, F.explode(listed))
    return product


def single_axis_cases(cases: DataFrame, axes: list[str]) -> DataFrame:
    """Every value of each axis while the others keep their first value: a row per value, no list of them."""
    values = _values(cases, axes)

    def cell(axis):
        first = values.where(F.col("axis") == axis).agg(F.min("val")).scalar()
        return F.when(F.col("axis") == axis, F.col("val")).otherwise(first).alias(axis)

    return values.select(F.col("axis").alias("swept"), *map(cell, axes))


def covered_pairs(wide: DataFrame, axes: list[str]) -> DataFrame:
    """Value pairs of axis pairs that some case covers; wide has one column per axis."""
    pairs = [
        F.struct(F.lit(a).alias("axis_a"), F.col(a).alias("val_a"), F.lit(b).alias("axis_b"), F.col(b).alias("val_b"))
        for i, a in enumerate(axes) for b in axes[i + 1:]
    ]
    return wide.select(F.inline(F.array(*pairs))).distinct()


def uncovered_pairs(cases: DataFrame, wide: DataFrame, axes: list[str]) -> DataFrame:
    """All value pairs of axis pairs minus the covered ones; pairs are rows of a join on the second axis."""
    values = _values(cases, axes)
    partners = F.create_map(*[x for i, a in enumerate(axes) for x in (F.lit(a), F.array(*map(F.lit, axes[i + 1:])).cast("array<string>"))])
    left = values.select(
        F.col("axis").alias("axis_a"), F.col("val").alias("val_a"), F.explode(F.try_element_at(partners, F.col("axis"))).alias("axis_b"))
    every = left.join(values.select(F.col("axis").alias("axis_b"), F.col("val").alias("val_b")), "axis_b")
    return every.join(covered_pairs(wide, axes), ["axis_a", "val_a", "axis_b", "val_b"], "left_anti").select("axis_a", "val_a", "axis_b", "val_b")


def fold_distinct(wide: DataFrame, axes: list[str], folds: dict[str, dict[str, str]]) -> DataFrame:
    """Raw and folded numbers of distinct cases.

    folds maps an axis value to the representative of its class; values without
    an entry stand for themselves.
    """

    def rep(axis):
        table = folds.get(axis)
        if not table:
            return F.col(axis)
        literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(F.try_element_at(literal, F.col(axis)), F.col(axis))

    raw = wide.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    folded = raw.select(*[rep(a).alias(a) for a in axes], "n").groupBy(*axes).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"))
    return folded.agg(
        F.sum("n").alias("cases"), F.sum("members").alias("raw_distinct"), F.count(F.lit(1)).alias("folded_distinct"))
