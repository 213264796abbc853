"""Counts and sizes of the differences of each measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.classify import STATUS, finite_pair
from ..plans.diff import DiffResult


def check_result(d: DiffResult) -> None:
    if not isinstance(d, DiffResult):
        raise InputError("`d` must be a result of diff_table()")


def ordinal(column: Column, values: list[str]) -> Column:
    """The place of a value in a short list."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), column)


def root_mean_square(size: Column) -> Column:
    """Of sizes whose squares may be beyond what a double holds, in one pass.

    Sums of squares are kept at three scales, powers of two and so without
    rounding; the largest size tells which of them can neither overflow nor vanish.
    """
    top, scale = F.max(size), 2.0**600

    def at(k: float) -> Column:
        return F.sqrt(F.avg((size * k) * (size * k))) / k

    exact = F.when(top > 1e150, at(1 / scale)).when(top < 1e-140, at(scale)).otherwise(at(1.0))
    return F.when((top == float("inf")) | (top == 0), top).otherwise(exact)


def diff_summary(d: DiffResult) -> DataFrame:
    """A row for each measure, in x's order: n, n_same, n_changed, n_only_x, n_only_y.

    For cells also max_abs_diff, mean_abs_diff, rmse and max_rel_diff over the
    pairs of finite values, within tolerance or not; null without such a pair.
    Without measures it is one row, of zeros if there is none.
    """
    check_result(d)
    status = d.own("status")
    counts = [F.count("*").alias("n"), *[F.count_if(status == s).alias(f"n_{s}") for s in STATUS]]
    if not d.measures:
        return d.df.agg(*counts)
    df = d.df.withColumn("__metric", d.own("metric"))
    if d.shape == "cells":
        pair = finite_pair(d.own("value_x"), d.own("value_y"))
        size, rel = F.when(pair, d.own("abs_diff")), F.when(pair, d.own("rel_diff"))
        counts += [F.max(size).alias("max_abs_diff"), F.avg(size).alias("mean_abs_diff"), root_mean_square(size).alias("rmse"), F.max(rel).alias("max_rel_diff")]
    out = df.groupBy("__metric").agg(*counts)
    return out.orderBy(ordinal(F.col("__metric"), d.measures)).withColumnRenamed("__metric", "metric")
