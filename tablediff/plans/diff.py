"""The comparison: align the rows of two tables, then classify each value."""

from __future__ import annotations

import math
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import (
    ColumnsError, DisjointError, DuplicatesError, DuplicatesWarning, InputError, KeysError, MeasuresError, Note, TypesError, listed, log,
)
from ..functions.cast import Cast, Truncation
from ..functions.classify import relative_sql, same_value_sql, status_sql
from ..functions.names import Name, canonical_name, check_names, name_map
from ..functions.types import CAST_TYPES, MEASURE_TYPES, SPARK_TYPES, col_type
from ..operators.keys import counted, dry_run, folded, multiset, same_keys
from ..operators.measures import select_measures, unpivot
from ..operators.rows import numbered, occurrence, virtual_key

#: Columns that the engine adds to the identity.
OWN = {
    "row_number", "key_seq", "metric", "row_id_x", "row_id_y", "value_x", "value_y", "diff", "abs_diff", "rel_diff", "status",
    "n_rows_x", "n_rows_y", "n_na_x", "n_na_y", "value_key_x", "value_key_y",
}


@dataclass(frozen=True)
class DiffResult:
    """A comparison. `df` has a row for each row and measure (`cells`), row (`rows`) or key and measure (`groups`).

    `columns` gives the names of the engine's own columns in `df`: one that
    differs from a user's column only by case has an underscore at its end,
    since Spark does not tell them apart.
    """

    df: DataFrame
    shape: str
    ids: list[str]
    measures: list[str]
    mode: str
    tolerance: float
    rel_tol: float
    name_map: list[tuple[Name, Name]]
    columns: dict[str, str]
    paired: bool = False
    dropped: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    truncated: list[Truncation] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)
    lost_rows: DataFrame | None = None
    crossed: bool = False

    def own(self, name: str) -> Column:
        return F.col(self.columns[name])

    def differences(self) -> DataFrame:
        return self.df.where(self.own("status") != "same")

    def with_df(self, df: DataFrame) -> DiffResult:
        """The same comparison with another selection of its rows."""
        return replace(self, df=df)

    def persisted(self) -> DiffResult:
        """Keeps the result for the jobs that a summary and a report run over it."""
        return self.with_df(self.df.persist())

    def sorted(self) -> DataFrame:
        """In order of the identity and the measure, missing values first, NaN next."""
        types = dict(self.df.dtypes)
        order = []
        for c in [*self.ids, *(self.columns[n] for n in ("key_seq", "metric") if self.columns[n] in types)]:
            if types[c] == "double":
                order.append(F.when(F.col(c).isNull(), 0).when(F.isnan(c), 1).otherwise(2))
            order.append(F.col(c).asc_nulls_first())
        if self.crossed:  # a key has several pairs of rows
            order += [self.own(n).asc_nulls_first() for n in ("row_id_x", "row_id_y")]
        return self.df.orderBy(*order)

    def truncated_rows(self) -> DataFrame:
        """(column, row_id_y) of every value that the cast truncated."""
        if self.lost_rows is not None:
            return self.lost_rows
        return self.df.sparkSession.createDataFrame([], "column string, row_id_y long")

    def label(self, column: str) -> str:
        """The spelling of x."""
        return next((x.name for x, _ in self.name_map if x.column == column), column)

    def summary(self) -> DataFrame:
        from ..operators.summary import diff_summary

        return diff_summary(self)

    def report(self, **options):
        from .report import diff_report

        return diff_report(self, **options)


def _choice(name: str, value: Any, options: tuple) -> None:
    if value not in options or isinstance(value, bool) != isinstance(options[0], bool):
        raise InputError(f"{name}={value!r}: expected {' or '.join(map(repr, options))}")


def diff_table(
    x: DataFrame,
    y: DataFrame,
    mode: str = "benchmark",
    by: str | list[str] | None = None,
    row_key: str = "none",
    measures: str | list[str] = "numeric",
    tolerance: float = 0,
    rel_tol: float = 0,
    duplicates: str = "disambiguate",
    cast: bool | None = None,
    truncate: bool = True,
    nan_is_na: bool = True,
    date_format: str = "%Y-%m-%d",
    order_by: list[str] | None = None,
    multisets: str = "text",
) -> DiffResult:
    """Compares two tables value by value.

    mode: in `benchmark`, y is tested against x, whose columns and types hold; in
        `equal`, both must have the same columns and types.
    by: the identity, by which rows are aligned; else every column that is no measure.
    row_key: adds row_number to the identity: `position`, or the place once both
        tables are `sorted` by the identity and the measures.
    measures: `numeric`, `numeric+integer`, or names.
    tolerance, rel_tol: finite values within either are the same.
    duplicates: repeated keys are paired in order of the rows (`disambiguate`),
        compared row by row, each of x with each of y, as SQL joins them (`cross`),
        compared as multisets (`aggregate`), or refused (`error`).
    cast: converts y to x's types (by default in benchmark mode).
    truncate: lets a cast drop fractions and times of day, and records it.
    nan_is_na: NaN and null are the same.
    order_by: the order of the rows, which numbers them; else that of arrival.
    multisets: how value_key_x and value_key_y hold the values of a key: as `text`,
        or as `counts`, an array of values and how often each occurs, which stays
        small for a key of very many rows with few different values.

    Tables are joined wide, in one shuffle of each by the identity, and measures
    become rows after the join. Up to three small jobs run before: what a cast
    would refuse, the sizes of partitions, and which keys repeat or align.
    """
    if not isinstance(x, DataFrame) or not isinstance(y, DataFrame):
        raise InputError("x and y: expected two DataFrames")
    if x.isStreaming or y.isStreaming:
        raise InputError("x and y: streams have no rows to align")
    _choice("mode", mode, ("benchmark", "equal"))
    _choice("row_key", row_key, ("none", "position", "sorted"))
    _choice("duplicates", duplicates, ("disambiguate", "cross", "aggregate", "error"))
    _choice("multisets", multisets, ("text", "counts"))
    for name, v in (("tolerance", tolerance), ("rel_tol", rel_tol)):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
            raise InputError(f"{name}={v!r}: expected a finite number of 0 or more")
    for name, v in (("truncate", truncate), ("nan_is_na", nan_is_na)):
        _choice(name, v, (True, False))
    if mode == "equal" and cast:
        raise InputError("cast=True needs mode='benchmark', which says whose types hold")
    cast = mode == "benchmark" if cast is None else cast
    _choice("cast", cast, (True, False))
    by = [by] if isinstance(by, str) else by
    if by is not None and (not isinstance(by, (list, tuple)) or not by or not all(isinstance(b, str) for b in by)):
        raise InputError(f"by={by!r}: expected names of columns, or None")
    if duplicates == "aggregate" and (tolerance > 0 or rel_tol > 0):
        raise InputError("multisets (duplicates='aggregate') know no tolerance; leave tolerance and rel_tol at 0")

    notes: list[Note] = []

    def note(kind: str, message: str, columns=()) -> None:
        notes.append(Note(kind, message, tuple(columns)))
        log.info(message)

    # Columns: x's, in x's order.
    map_x = check_names(name_map(x.columns), "x")
    map_y = name_map(y.columns)
    names = [n.column for n in map_x]
    check_names(map_y, "y", only=set(names) if mode == "benchmark" else None)
    in_y = {n.column for n in map_y}
    only_x = [n for n in map_x if n.column not in in_y]
    only_y = [n for n in map_y if n.column not in set(names)]
    if mode == "equal" and (only_x or only_y):
        sides = [f"{side} alone has {listed(n.label for n in odd)}" for side, odd in (("x", only_x), ("y", only_y)) if odd]
        raise ColumnsError(f"columns differ: {', '.join(sides)} (mode='equal')", columns=[n.name for n in only_x + only_y])
    if only_x:
        raise ColumnsError(f"y lacks {listed(n.label for n in only_x)}, which its benchmark has", columns=[n.name for n in only_x])
    if only_y:
        note("dropped_columns", f"left out of y, as x has no such columns: {listed(n.name for n in only_y)}", [n.name for n in only_y])
    pairs = [(n, next(m for m in map_y if m.column == n.column)) for n in map_x]
    label_x, label_y = {n.column: n.label for n, _ in pairs}, {m.column: m.label for _, m in pairs}

    # Types. Columns are called __0, __1, ... inside, so no name of a user is in the way.
    inner = {c: f"__{i}" for i, c in enumerate(names)}
    wx, wy = _inner(x, [n.name for n, _ in pairs], inner, order_by), _inner(y, [m.name for _, m in pairs], inner, order_by)
    types_x = {c: col_type(wx.schema[inner[c]].dataType) for c in names}
    types_y = {c: col_type(wy.schema[inner[c]].dataType) for c in names}
    if odd := [c for c in names if types_x[c] not in CAST_TYPES]:
        raise TypesError("no comparison is defined for " + ", ".join(f"{label_x[c]}: {types_x[c]}" for c in odd) + " (see normalize_types)", columns=odd)
    off = [c for c in names if types_x[c] != types_y[c]]
    if off and not cast:
        pairs_of = ", ".join(f"{label_x[c]} is {types_x[c]} in x and {types_y[c]} in y" for c in off)
        raise TypesError(f"{pairs_of}; types have to agree where nothing is cast", columns=off)

    # Roles.
    if by is not None:
        by = [canonical_name(b) for b in by]
        problems = [
            *([f"repeats {listed(sorted({b for b in by if by.count(b) > 1}))}"] if len(set(by)) < len(by) else []),
            *([f"has {listed(b for b in by if b not in inner)}, which the tables have not"] if set(by) - set(names) else []),
        ]
        if problems:
            raise ColumnsError("by " + " and ".join(problems), columns=by)
    if isinstance(measures, str) and measures in MEASURE_TYPES:
        chosen = select_measures({c: t for c, t in types_x.items() if c not in (by or [])}, measures)
    else:
        given = [measures] if isinstance(measures, str) else measures
        given = [canonical_name(m) if isinstance(m, str) else m for m in given] if isinstance(given, (list, tuple)) else given
        chosen = select_measures(types_x, given)
        if both := [m for m in chosen if m in (by or [])]:
            raise MeasuresError(f"{listed(label_x[b] for b in both)}: either part of the key (by) or a measure", columns=both)
    ids = [c for c in names if c not in chosen] if by is None else by
    if not ids and row_key == "none":
        raise KeysError(
            "no column is left for a key, as all are measures; give by, fewer measures, or row_key='position' or 'sorted'"
        )
    ignored = [c for c in names if c not in ids and c not in chosen]
    if ignored and mode == "equal":
        raise ColumnsError(f"{listed(label_x[c] for c in ignored)}: neither key nor measure, which mode='equal' does not allow", columns=ignored)
    if ignored:
        note("ignored_columns", f"neither key nor measure, so left alone: {listed(label_x[c] for c in ignored)}", ignored)
    if not chosen:
        note("no_measures", "without measures, a row is the same where the other table has its key")

    # Numbers and types of rows.
    needs_number = bool(cast and off) or duplicates != "aggregate" or row_key != "none"
    keys, dry = [inner[c] for c in ids], None
    kinds = {inner[c]: types_x[c] for c in names}
    with ThreadPoolExecutor(3) as pool:  # each runs a job
        if keys and row_key == "none" and not (cast and off):  # keys are as they will be compared
            dry = pool.submit(lambda w: dry_run(*w, keys).first().asDict(), [_wide(w, kinds, keys, [], nan_is_na, False) for w in (wx, wy)])
        casting = Cast({inner[c]: (label_y[c], types_y[c], types_x[c]) for c in names}, date_format, nan_is_na) if cast and off else None
        if needs_number:  # the job that numbers y also counts what its cast refuses
            tasks = [pool.submit(numbered, wx, "__row", _order(wx, order_by)), pool.submit(numbered, wy, "__row", _order(wy, order_by), *((casting.prepared, casting.sums) if casting else ()))]
            (wx, _), (wy, counts) = (t.result() for t in tasks)
        dry = dry and dry.result()
    truncated, lost_rows = [], None
    if casting:
        truncated, lost_rows = casting.judged(wy, "__row", counts, truncate)
        wy = casting.finished(wy, [*inner.values(), "__row"])
        if truncated:
            total = sum(t.n for t in truncated)
            note("truncation", f"the cast of y cut {total:,} values: " + "; ".join(f"{t.n:,} of {t.column}, as {t.examples}" for t in truncated), [t.column for t in truncated])

    # Wide tables of what is compared, with keys in which missing values are alike.
    values = [inner[c] for c in chosen]
    wx, wy = (_wide(w, kinds, keys, values, nan_is_na, needs_number) for w in (wx, wy))
    if row_key != "none":
        wx, wy = (virtual_key(w, row_key, "__row", "__number", keys, values) for w in (wx, wy))
        keys, ids = [*keys, "__number"], [*ids, "row_number"]

    # Repeats and alignment, from the counts of the keys.
    dry = dry or dry_run(wx, wy, keys).first().asDict()
    paired = crossed = False
    if duplicates != "aggregate" and (dry["dups_x"] or dry["dups_y"]):
        head = f"{dry['__repeated']:,} keys have several rows (key: {listed(ids)})"
        groups = _repeats(wx, wy, keys, ids)
        if duplicates == "error":
            raise DuplicatesError(f"{head}, which duplicates='error' refuses", duplicates=groups)
        if duplicates == "cross":
            crossed = True
            note("repeated_keys", f"{head}; each row of x is compared with each of y, in {dry['est_merge_rows']:,.0f} pairs over all keys", ids)
        else:
            wx, wy = (occurrence(w, keys, "__row", "__seq", dry["__most"]) for w in (wx, wy))
            paired = True
        if chosen and paired:
            warnings.warn(DuplicatesWarning(f"{head}; the first of x goes with the first of y and so on (key_seq), so both should list them alike", groups), stacklevel=2)
    if dry["rows_x"] + dry["rows_y"] and not dry["keys_common"]:
        empty = f"{'x' if not dry['rows_x'] else 'y'} has no rows" if not dry["rows_x"] or not dry["rows_y"] else "are their keys written alike?"
        raise DisjointError(f"x and y have no {'row' if by is None and not chosen else f'key ({listed(ids)})'} in common; {empty}", dry_run=dry)

    taken = {i.lower() for i in ids if i != "row_number"}
    columns = {c: c + "_" if c in taken else c for c in OWN}
    df, shape = _classified(wx, wy, keys, ids, values, chosen, columns, duplicates == "aggregate" and multisets, paired, tolerance, rel_tol, nan_is_na)
    return DiffResult(
        df, shape, [columns.get(i, i) if i == "row_number" else i for i in ids], chosen, mode, float(tolerance), float(rel_tol), pairs, columns, paired,
        [n.name for n in only_y], [label_x[c] for c in ignored], truncated, notes, lost_rows, crossed,
    )


def _inner(df: DataFrame, wanted: list[str], inner: dict[str, str], order_by: list[str] | None) -> DataFrame:
    """The wanted columns under inner names. Columns are named by position first, as names may differ by case only."""
    placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    order = [f"c{at[_column(df, o)]}" for o in order_by or []]
    # Expressions as text: with hundreds of columns, making them one by one takes longer than a small comparison.
    return placed.selectExpr(*[f"c{at[n]} AS {k}" for n, k in zip(wanted, inner.values())], *[f"{c} AS __o{i}" for i, c in enumerate(order)])


def _column(df: DataFrame, name: str) -> str:
    for c in df.columns:
        if c == name or canonical_name(c) == canonical_name(name):
            return c
    raise ColumnsError(f"`order_by` names no column: {name}", columns=[name])


def _order(df: DataFrame, order_by: list[str] | None) -> list[Column] | None:
    return [F.col(f"__o{i}").asc_nulls_first() for i in range(len(order_by))] if order_by else None


def _wide(df: DataFrame, types: dict[str, str], keys: list[str], values: list[str], nan_is_na: bool, numbered: bool) -> DataFrame:
    def key(k: str) -> str:
        v = f"CAST({k} AS {SPARK_TYPES[types[k]]})"
        return f"IF(isnan({v}), NULL, {v}) AS {k}" if nan_is_na and types[k] == "numeric" else f"{v} AS {k}"

    row = ["CAST(__row AS BIGINT) AS __row"] if numbered else []
    return df.selectExpr(*map(key, keys), *[f"CAST({v} AS DOUBLE) AS {v}" for v in values], *row)


def _repeats(wx: DataFrame, wy: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    side = lambda w, s: w.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(F.lit(s).alias("side"), *[F.col(k).alias(i) for k, i in zip(keys, ids)], "n_rows")
    return side(wx, "x").union(side(wy, "y")).orderBy("side", F.desc("n_rows"))


def _classified(wx, wy, keys, ids, values, chosen, columns, aggregate, paired, tolerance, rel_tol, nan_is_na) -> tuple[DataFrame, str]:
    """Joins the wide tables and gives every value its status."""
    if aggregate:
        return _multisets(wx, wy, keys, ids, values, chosen, columns, nan_is_na, multiset if aggregate == "text" else counted), "groups"
    on = [*keys, "__seq"] if paired else keys
    a = wx.toDF(*[f"{c}_x" for c in wx.columns])
    b = wy.toDF(*[f"{c}_y" for c in wy.columns])
    j = a.join(b, same_keys(a, b, [f"{k}_x" for k in on], [f"{k}_y" for k in on]), "full")
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    key = lambda k: f"IF(__row_x IS NOT NULL, {k}_x, {k}_y)"  # noqa: E731  a key may itself be null
    kept_names = [columns.get(i, i) if i == "row_number" else i for i in ids] + ([columns["key_seq"]] if paired else [])
    kept = [f"{key(k)} AS {quoted(n)}" for k, n in zip([*keys, "__seq"], kept_names)]
    own = {k: quoted(v) for k, v in columns.items()}
    if not values:
        return j.selectExpr(*kept, f"__row_x AS {own['row_id_x']}", f"__row_y AS {own['row_id_y']}", f"{status_sql('__row_x', '__row_y', 'true')} AS {own['status']}"), "rows"
    cells = [[f"{v}_x", f"{v}_y"] for v in values]
    plain = [f"__g{i}" for i in range(len(kept_names))]
    long = unpivot(j.selectExpr(*[f"{key(k)} AS {g}" for k, g in zip([*keys, "__seq"], plain)], "__row_x", "__row_y", *[c for pair in cells for c in pair]), [*plain, "__row_x", "__row_y"], chosen, cells, ["__vx", "__vy"])
    return long.selectExpr(
        *[f"{g} AS {quoted(n)}" for g, n in zip(plain, kept_names)], f"metric AS {own['metric']}", f"__row_x AS {own['row_id_x']}", f"__row_y AS {own['row_id_y']}",
        f"__vx AS {own['value_x']}", f"__vy AS {own['value_y']}", f"__vy - __vx AS {own['diff']}", f"abs(__vy - __vx) AS {own['abs_diff']}", f"{relative_sql('__vx', '__vy')} AS {own['rel_diff']}",
        f"{status_sql('__row_x', '__row_y', same_value_sql('__vx', '__vy', tolerance, rel_tol, nan_is_na))} AS {own['status']}",
    ), "cells"


def _multisets(wx, wy, keys, ids, values, chosen, columns, nan_is_na, held) -> DataFrame:
    """A row for each key and measure: how many rows each side has, and whether their values are the same in any order.

    Both sides are counted by key and value in one aggregation, which shrinks
    them before they are shuffled, so a key in very many rows takes as little as
    one in few. Only value_key_x and value_key_y hold the values themselves;
    where they are not asked for, they are not made. `held` makes them.
    """
    own = columns
    sides = [w.select(*keys, *values, F.lit(x).alias("__nx"), F.lit(1 - x).alias("__ny")) for w, x in ((wx, 1), (wy, 0))]
    both = sides[0].union(sides[1])
    nx, ny, v = F.col("__nx"), F.col("__ny"), F.col("__v")
    names = [own.get(i, i) if i == "row_number" else i for i in ids]
    some = lambda n: F.nullif(F.sum(n), F.lit(0))
    if not values:
        out = both.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(some(nx).alias("x"), some(ny).alias("y"))
        state = F.expr(status_sql("x", "y", "x = y")).alias(own["status"])
        return out.select(*names, F.col("x").alias(own["n_rows_x"]), F.col("y").alias(own["n_rows_y"]), state)
    long = unpivot(both, [*[F.col(k) for k in keys], nx, ny], chosen, [[x] for x in values], ["__v"])
    long = long.withColumn("__v", folded(v)) if nan_is_na else long
    each = long.groupBy(*keys, "metric", "__v").agg(F.sum(nx).alias("__nx"), F.sum(ny).alias("__ny"))
    empty = v.isNull() | F.isnan(v)
    groups = each.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col("metric").alias("__m")).agg(
        some(nx).alias("__x"), some(ny).alias("__y"), F.sum(F.when(empty, nx).otherwise(0)).alias("__ex"), F.sum(F.when(empty, ny).otherwise(0)).alias("__ey"),
        F.max(nx != ny).alias("__off"), held(v, nx).alias("__kx"), held(v, ny).alias("__ky"),
    )
    x, y = F.col("__x"), F.col("__y")
    return groups.select(
        *[F.col(f"__g{i}").alias(n) for i, n in enumerate(names)], F.col("__m").alias(own["metric"]), x.alias(own["n_rows_x"]), y.alias(own["n_rows_y"]),
        F.when(x.isNotNull(), F.col("__ex")).alias(own["n_na_x"]), F.when(y.isNotNull(), F.col("__ey")).alias(own["n_na_y"]),
        F.when(x.isNotNull(), F.col("__kx")).alias(own["value_key_x"]), F.when(y.isNotNull(), F.col("__ky")).alias(own["value_key_y"]),
        F.expr(status_sql("__x", "__y", "NOT __off")).alias(own["status"]),
    )
