"""A bounded report of a comparison: computed here, drawn by `render`."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.cast import Truncation
from ..functions.classify import finite_pair
from ..operators.summary import check_result
from ..sources.workspace import stash
from .diff import DiffResult


@dataclass
class RowCounts:
    """Rows (or keys, or pairs of crossed rows) in each table and by what became of them; a row is changed if any of its measures is."""

    n_x: int
    n_y: int
    n_only_x: int
    n_same: int
    n_changed: int
    n_only_y: int


@dataclass
class DiffReport:
    """What a report says; a plain record that needs no data any more."""

    x_name: str
    y_name: str
    mode: str
    shape: str
    unit: str
    identity: list[str]
    measures: list[str]
    paired: bool
    tolerance: float
    rel_tol: float
    dropped: list[str]
    ignored: list[str]
    truncated: list[Truncation]
    rows: RowCounts
    by_measure: list[dict[str, Any]]
    changes: list[dict[str, Any]]
    only_x: list[tuple]
    only_y: list[tuple]
    top_k: int
    equal: bool
    key_types: list[str] = field(default_factory=list)
    crossed: bool = False

    def format(self, unicode: bool = True) -> list[str]:
        from .render import draw

        return draw(self, unicode)

    def __str__(self) -> str:
        return "\n".join(self.format())


def _present(d: DiffResult) -> tuple[Column, Column]:
    name = "n_rows" if d.shape == "groups" else "row_id"
    return d.own(f"{name}_x").isNotNull(), d.own(f"{name}_y").isNotNull()


def _row_keys(d: DiffResult) -> list[str]:
    own = ["key_seq"] if d.paired else ["row_id_x", "row_id_y"] if d.crossed else []
    return [*d.ids, *(d.columns[n] for n in own)]


def collapsed(d: DiffResult) -> DataFrame:
    """A row for each compared row or key: the identity, __x and __y (is it there), __c (has any measure changed)."""
    in_x, in_y = _present(d)
    flag = lambda c, n: F.max(c.cast("int")).alias(n)
    return d.df.groupBy(*_row_keys(d)).agg(flag(in_x, "__x"), flag(in_y, "__y"), flag(d.own("status") == "changed", "__c"))


def row_counts(d: DiffResult) -> DataFrame:
    """One row: n_x, n_y, n_only_x, n_same, n_changed, n_only_y."""
    x, y, c = F.col("__x") == 1, F.col("__y") == 1, F.col("__c") == 1
    return collapsed(d).agg(
        F.count_if(x).alias("n_x"), F.count_if(y).alias("n_y"), F.count_if(x & ~y).alias("n_only_x"),
        F.count_if(x & y & ~c).alias("n_same"), F.count_if(x & y & c).alias("n_changed"), F.count_if(~x & y).alias("n_only_y"),
    )


def top_changes(d: DiffResult, top_k: int = 3) -> DataFrame:
    """The most frequent changes of each measure: metric, value_x, value_y, n, n_distinct, abs_diff, place, and the first row's identity.

    Equally frequent ones are in order of their size, then of their values.
    """
    row = F.struct(F.coalesce(d.own("row_id_x"), d.own("row_id_y")).alias("at"), F.struct(*[F.col(i) for i in d.ids]).alias("key"))
    each = d.df.where(d.own("status") == "changed").groupBy(
        d.own("metric").alias("metric"), d.own("value_x").alias("value_x"), d.own("value_y").alias("value_y")
    ).agg(F.count("*").alias("n"), F.first(d.own("abs_diff")).alias("abs_diff"), F.min(row).alias("__first"))
    order = Window.partitionBy("metric").orderBy(F.desc("n"), F.desc_nulls_last("abs_diff"), "value_x", "value_y")
    counted = each.withColumn("place", F.row_number().over(order))
    # The number of distinct changes by an aggregation of its own; a window over all of them would hold a measure's changes at once.
    distinct = each.groupBy(F.col("metric").alias("__of")).agg(F.count("*").alias("n_distinct"))
    top = counted.where(F.col("place") <= top_k)
    return top.join(distinct, F.col("metric") == F.col("__of")).select(
        "metric", "value_x", "value_y", "n", "n_distinct", "abs_diff", "place", F.col("__first.key").alias("example")
    )


def one_sided(d: DiffResult, side: str, k: int | None = None) -> DataFrame:
    """The keys that only one side has, each once, in order; `k` of them at most."""
    here, there = ("__x", "__y") if side == "x" else ("__y", "__x")
    keys = collapsed(d).where((F.col(here) == 1) & (F.col(there) == 0)).select(*d.ids).distinct().orderBy(*[F.col(i).asc_nulls_first() for i in d.ids])
    return keys if k is None else keys.limit(k)


@contextmanager
def kept(d: DiffResult) -> Iterator[None]:
    """Persists the result as long as the block runs, on disk where memory does not suffice."""
    if d.df.storageLevel.useMemory or d.df.storageLevel.useDisk:
        yield
        return
    d.df.persist()
    try:
        yield
    finally:
        d.df.unpersist()


#: What a row of facts() is about: a compared row, a measure, a change of a measure, a one-sided key.
ROW, MEASURE, CHANGE, ONE_SIDED = range(4)


def facts(d: DiffResult) -> DataFrame:
    """All that a report says, from one pass over the result, in which every value counts for its row, its measure and its change.

    These are grouping sets of one aggregation, partial before its shuffle. The
    result has a row for each compared row, measure, different change and
    one-sided key, with the counts and sizes that belong to it.
    """
    in_x, in_y = _present(d)
    status, cells = d.own("status"), d.shape == "cells"
    changed, none = status == "changed", F.lit(None)
    key, ids = F.struct(*[F.col(k) for k in _row_keys(d)]), F.struct(*[F.col(i) for i in d.ids])
    metric = d.own("metric") if d.measures else none.cast("string")
    x, y = (d.own("value_x"), d.own("value_y")) if cells else (none.cast("double"), none.cast("double"))

    def fact(kind: int, key: Column, ids: Column, side: Column, metric: Column, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), ids.alias("ids"), side.alias("side"), metric.alias("metric"), x.alias("vx"), y.alias("vy"))

    no_key, no_ids, no_text, no_value = F.when(F.lit(False), key), F.when(F.lit(False), ids), none.cast("string"), none.cast("double")
    sets = [fact(ROW, key, no_ids, no_text, no_text, no_value, no_value)]
    # A row is on one side only if none of its values is on both; all values of a row are on the same sides.
    sets.append(F.when(~in_x | ~in_y, fact(ONE_SIDED, no_key, ids, F.when(in_x, "x").otherwise("y"), no_text, no_value, no_value)))
    if d.measures:
        sets.append(fact(MEASURE, no_key, no_ids, no_text, metric, no_value, no_value))
    if cells:
        sets.append(F.when(changed, fact(CHANGE, no_key, no_ids, no_text, metric, x, y)))
        at = F.coalesce(d.own("row_id_x"), d.own("row_id_y"))
        pair = finite_pair(x, y)
        abs_diff, size, rel = d.own("abs_diff"), F.when(pair, d.own("abs_diff")), F.when(pair, d.own("rel_diff"))
    else:
        at, (abs_diff, size, rel) = none.cast("long"), [no_value] * 3
    flags = [in_x.alias("x"), in_y.alias("y"), changed.alias("c"), status.alias("s"), abs_diff.alias("abs"), size.alias("size"), rel.alias("rel"), at.alias("at"), ids.alias("id")]
    each = d.df.select(F.explode(F.array_compact(F.array(*sets))).alias("f"), *flags).select("f.*", *[F.col(n) for n in ("x", "y", "c", "s", "abs", "size", "rel", "at", "id")])
    first = F.min(F.when(F.col("kind") == CHANGE, F.struct("at", "id")))
    return each.groupBy("kind", "key", "ids", "side", "metric", "vx", "vy").agg(
        F.count("*").alias("n"), F.count_if(F.col("s") == "same").alias("n_same"), F.count_if("c").alias("n_changed"), F.max("x").alias("x"), F.max("y").alias("y"),
        F.max("c").alias("c"), F.first("abs").alias("abs"), F.max("size").alias("max_abs"), F.max("rel").alias("max_rel"), first["id"].alias("example"),
    )


def diff_report(d: DiffResult, x_name: str = "x", y_name: str = "y", top_k: int = 3, sample_k: int = 5) -> DiffReport:
    """Counts of rows, sizes of the differences by measure, the most frequent changes, and samples of one-sided keys.

    Reads the result once (see facts()); what is left is written to the shared
    folder, and two small queries count it and take the first few of it.
    """
    check_result(d)
    if not all(isinstance(n, str) and n for n in (x_name, y_name)):
        raise InputError("`x_name` and `y_name` must be names")
    for name, v in (("top_k", top_k), ("sample_k", sample_k)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise InputError(f"`{name}` must be a whole number >= 0")
    label = {c: d.label(c) for c in [*d.ids, *d.measures]}
    known = stash(facts(d), "facts")

    # Some numbers for each kind and measure.
    x, y, c = F.col("x"), F.col("y"), F.col("c")
    counts = {
        (r["kind"], r["metric"]): r.asDict()
        for r in known.groupBy("kind", "metric").agg(
            F.count("*").alias("n"), F.sum("n_same").alias("n_same"), F.sum("n_changed").alias("n_changed"), F.max("max_abs").alias("max_abs"), F.max("max_rel").alias("max_rel"),
            F.count_if(x).alias("rows_x"), F.count_if(y).alias("rows_y"), F.count_if(x & ~y).alias("only_x"), F.count_if(y & ~x).alias("only_y"),
            F.count_if(x & y & ~c).alias("same"), F.count_if(x & y & c).alias("changed"),
        ).collect()
    }
    total = counts.get((ROW, None), {})
    rows = RowCounts(*(total.get(k, 0) for k in ("rows_x", "rows_y", "only_x", "same", "changed", "only_y")))
    equal = rows.n_only_x == rows.n_only_y == rows.n_changed == 0

    # The first of each kind, measure and side: the most frequent changes, and keys in their order. Each task sorts out its own first ones.
    top, keys = [], {"x": [], "y": []}
    if not equal and top_k + sample_k:
        change = F.col("kind") == CHANGE
        order = Window.partitionBy("kind", "metric", "side").orderBy(F.when(change, -F.col("n")), F.when(change, -F.col("abs")).asc_nulls_last(), "vx", "vy", "ids")
        most = F.when(change, top_k).otherwise(sample_k)
        first = known.where(F.col("kind").isin(CHANGE, ONE_SIDED)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(top_k, sample_k)).where(F.col("place") <= most)
        for r in sorted(first.collect(), key=lambda r: r["place"]):
            if r["kind"] == CHANGE:
                top.append(r)
            else:
                keys[r["side"]].append(tuple(r["ids"]))
    by_measure = []
    for m in d.measures:
        if r := counts.get((MEASURE, m)):
            joined = r["n_same"] + r["n_changed"]
            by_measure.append({"measure": label[m], "n_same": r["n_same"], "n_changed": r["n_changed"], "match_rate": r["n_same"] / joined if joined else None})
            if d.shape == "cells":
                by_measure[-1] |= {"max_abs_diff": r["max_abs"], "max_rel_diff": r["max_rel"], "n_distinct_changes": counts.get((CHANGE, m), {}).get("n", 0)}
    changes = [
        {"measure": label[r["metric"]], "value_x": r["vx"], "value_y": r["vy"], "n": r["n"], "example": tuple(r["example"])}
        for r in sorted(top, key=lambda r: (d.measures.index(r["metric"]), r["place"]))
    ]
    return DiffReport(
        x_name, y_name, d.mode, d.shape, "keys" if d.shape == "groups" else "pairs" if d.crossed else "rows", [label[i] for i in d.ids], [label[m] for m in d.measures],
        d.paired, d.tolerance, d.rel_tol, d.dropped, d.ignored, d.truncated, rows, by_measure, changes, keys["x"], keys["y"], top_k, equal, crossed=d.crossed,
    )
