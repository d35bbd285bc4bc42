"""Exact interpolated quantiles that no single task has to hold.

The built-in exact percentile keeps every distinct value of a group in one task. Here the
values are first counted (a value holding a third of the rows becomes one row), then cut
at sketched boundaries into even slices, and only the slices that hold a wanted rank are
sorted. The sketch decides how even the slices are, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def slice_number(cuts: str, value: Column) -> Column:
    """How many of the sorted ``cuts`` lie below ``value``.

    Never null: a null test inferred for a join on it would be pushed below the counting and
    compute the value once per cut and row there.
    """
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < value)), F.lit(0))


def quantile_rows(
    df: DataFrame, value: str, ps: list[float], by: list[str] | None = None
) -> DataFrame:
    """``(*by, p, quantile)`` with linear interpolation between neighbouring values.

    Nulls are ignored; a group without values gives no rows.
    """
    by = by or []
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    cuts = [i / SLICES for i in range(1, SLICES)]
    shape = counts.groupBy(*by).agg(
        F.sum("_n").alias("_total"),
        F.percentile_approx("_v", cuts, 10_000).alias("_cuts"),
    )
    if by:
        sliced = counts.join(shape, by)
    else:
        one = shape.select(F.struct("_total", "_cuts").alias("s")).scalar()
        sliced = counts.select("_v", "_n", one["_total"].alias("_total"), one["_cuts"].alias("_cuts"))
    sliced = sliced.withColumn("_slice", slice_number("_cuts", F.col("_v"))).drop("_cuts")

    held = sliced.groupBy(*by, "_slice").agg(
        F.sum("_n").alias("_held"), F.first("_total").alias("_total")
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most SLICES rows per group from here until the rows are joined back
    held = held.withColumn("_offset", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    wanted = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.floor(F.lit(float(p)) * (F.col("_total") - 1)).alias("lo"),
                F.ceil(F.lit(float(p)) * (F.col("_total") - 1)).alias("hi"),
            )
            for p in ps
        ]
    )
    touched = F.filter(
        wanted,
        lambda w: (w["lo"] < F.col("_offset") + F.col("_held")) & (w["hi"] >= F.col("_offset")),
    )
    picked = held.select(*by, "_slice", "_offset", touched.alias("_wanted")).where(
        F.size("_wanted") > 0
    )

    order = Window.partitionBy(*by, "_slice").orderBy("_v")
    ranked = (
        sliced.join(picked, [*by, "_slice"])
        .withColumn("_last", F.col("_offset") + F.sum("_n").over(order) - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
        .withColumn("_w", F.explode("_wanted"))
    )
    holds = lambda rank: (F.col("_first") <= rank) & (rank <= F.col("_last"))
    lo, hi, p = F.col("_w.lo"), F.col("_w.hi"), F.col("_w.p")
    ends = (
        ranked.where(holds(lo) | holds(hi))
        .groupBy(*by, p.alias("p"))
        .agg(
            F.max(F.when(holds(lo), F.col("_v"))).alias("_lo_v"),
            F.max(F.when(holds(hi), F.col("_v"))).alias("_hi_v"),
            F.max(p * (F.col("_total") - 1) - lo).alias("_frac"),
        )
    )
    return ends.select(
        *by, "p", (F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * F.col("_frac")).alias("quantile")
    )


def column_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the exact median of every column, named like the column."""
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                    for c in cols
                ]
            )
        ).alias("f")
    ).select("f.feature", "f.value")
    medians = quantile_rows(long, "value", [0.5], by=["feature"])
    return medians.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(c) for c in cols]
    )


