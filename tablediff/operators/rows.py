"""Row numbers on tables that have none: of all rows, and of the rows of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import stash

#: Rows of one key that are numbered in one task. A larger group is dealt to many.
TASK_ROWS = 1_000_000
#: monotonically_increasing_id() has the partition above these bits and the place in it below.
PLACE_BITS = 33


def repeatable(df: DataFrame) -> bool:
    """Whether every evaluation of `df` gives the same rows in the same order, as far as its plan tells.

    A scan does, with whatever maps and filters its rows; what comes from a
    shuffle arrives in an order of its own each time.
    """
    plan = df._jdf.queryExecution().executedPlan()
    nodes = [plan]
    for node in nodes:
        if "Exchange" in node.nodeName() or node.nodeName() == "AdaptiveSparkPlan":
            return False
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return plan.execute().outputDeterministicLevel().toString() == "DETERMINATE"


def placed(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Adds __at, which is in the given order, else in order of arrival, and the same at every evaluation.

    With an order, rows are dealt by ranges of it, so that no task holds them
    all, and written, as ranges come from a sample that another run may draw
    anew. Without one, only an input that need not arrive alike twice is written.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        return stash(df.withColumn("__at", F.monotonically_increasing_id()), "rows")
    numbered = df.withColumn("__at", F.monotonically_increasing_id())
    return numbered if repeatable(df) else stash(numbered, "rows")


def part_of(at: Column) -> Column:
    return F.shiftright(at, PLACE_BITS).cast("long")


def numbered(
    df: DataFrame, name: str, order: list[Column] | None = None, then: Callable[[DataFrame], DataFrame] | None = None, sums: dict[str, Column] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """As number_rows(), with `then` applied to the rows; the job that counts them adds up `sums` of its columns, too."""
    df = placed(df, order)
    df = then(df) if then else df
    found = [F.sum(c).alias(f"__s{i}") for i, c in enumerate((sums or {}).values())]
    counts = df.groupBy(part_of(F.col("__at")).alias("__part")).agg(F.count("*").alias("__n"), *found).collect()
    totals = {k: sum(row[f"__s{i}"] or 0 for row in counts) for i, k in enumerate(sums or {})}
    before, total = [], 0
    for row in sorted(counts, key=lambda r: r["__part"]):
        before.append((row["__part"], total))
        total += row["__n"]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long")).drop("__at"), totals
    offsets = df.sparkSession.createDataFrame(before, "__p long, __before long")
    out = df.join(offsets, part_of(F.col("__at")) == F.col("__p"))  # a row for each partition; Spark broadcasts it up to its limit
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return out.withColumn(name, F.col("__before") + place + 1).drop("__at", "__p", "__before"), totals


def number_rows(df: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """Adds a dense 1-based number (bigint): in the given order, else in order of arrival.

    Rows keep to their partitions, which are counted by one extra job; the
    counts (one row for each partition) give each its first number. Numbers are
    the same at every evaluation: see placed().
    """
    return numbered(df, name, order)[0]


def occurrence(df: DataFrame, keys: list[str], order: str | list[Column], name: str, largest: int | None = None) -> DataFrame:
    """Adds the number (bigint) of each row among those with its keys, in the given order.

    `largest` is how many rows a key has at most, if that is known; else it is
    counted. Up to TASK_ROWS, each key is numbered in one task. Beyond, rows are
    dealt by ranges of key and order, numbered in each range, and go on from
    where the ranges before have left off: see dealt_occurrence(). Numbers are
    the same either way, if the order leaves no ties.
    """
    order = [F.col(order)] if isinstance(order, str) else order
    if largest is None:
        largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > TASK_ROWS:
        return dealt_occurrence(df, keys, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def dealt_occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """As occurrence(), for keys of any number of rows: a prefix sum over segments.

    The rows of a key are consecutive in the order of key and order, and ranges
    of that order are the partitions. Only the first key of a range can have
    begun in an earlier one. So each range is numbered by itself, and the first
    key's rows in earlier ranges are added: their number is taken from the ranges
    whose last key is the same, of which one row each goes to the driver.
    """
    rows = placed(df, [*[F.col(k).asc_nulls_first() for k in keys], *order]).withColumn("__part", part_of(F.col("__at")))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ends = rows.groupBy("__part").agg(F.min_by(key, "__at").alias("a"), F.max_by(key, "__at").alias("b")).withColumn("whole", F.col("a").eqNullSafe(F.col("b")))
    # Where the last key goes on: the next range that has rows begins with it.
    order_of_parts = Window.orderBy("__part")  # over a row for each range
    ends = ends.withColumn("goes_on", F.col("b").eqNullSafe(F.lead("a").over(order_of_parts)) & F.lead("__part").over(order_of_parts).isNotNull())
    ends = ends.withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    open_ = ends.where("goes_on").select(F.col("__part").alias("__p"), F.col("b").alias("__last"))
    last = rows.join(open_, F.col("__part") == F.col("__p")).where(key.eqNullSafe(F.col("__last"))).groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    links = ends.join(last, F.col("__part") == F.col("__p"), "left").select("__part", "whole", "goes_on", F.coalesce("__n", F.lit(0)).alias("n")).orderBy("__part").collect()
    carried, carry = [], 0
    for link in links:
        carried.append((link["__part"], carry))
        carry = (carry if link["whole"] else 0) + link["n"] if link["goes_on"] else 0
    if not carried:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("__at", "__part")
    before = rows.sparkSession.createDataFrame(carried, "__p long, __carry long")
    # Each range goes to a task as it is; the windows below are within ranges, so they need no other exchange.
    spread = rows.repartition("__part")
    own = F.row_number().over(Window.partitionBy("__part", *keys).orderBy("__at")).cast("long")
    first = F.min("__at").over(Window.partitionBy("__part", *keys)) == F.min("__at").over(Window.partitionBy("__part"))
    out = spread.withColumn("__own", own).withColumn("__first", first).join(before, F.col("__part") == F.col("__p"))
    number = F.col("__own") + F.when(F.col("__first"), F.col("__carry")).otherwise(0)
    return out.withColumn(name, number).drop("__at", "__part", "__p", "__carry", "__own", "__first")


def virtual_key(df: DataFrame, how: str, row_id: str, name: str, groups: list[str] = (), sort_by: list[str] = ()) -> DataFrame:
    """Adds a key (bigint): the row's number (`position`), or its place by `groups` and `sort_by` (`sorted`).

    Missing values, NaN too, come last; ties keep the order of `row_id`. Within
    groups the numbers begin anew, and a group of any size is numbered: see
    occurrence().
    """
    if how == "position":
        return df.withColumn(name, F.col(row_id).cast("long"))
    types = dict(df.dtypes)
    last = lambda c: F.when(~F.isnan(c), F.col(c)) if types[c] in ("double", "float") else F.col(c)
    order = [last(c).asc_nulls_last() for c in sort_by] + [F.col(row_id).asc()]
    return occurrence(df, list(groups), order, name) if groups else number_rows(df, name, order)
