"""The columns of two tables side by side: types, distinct values, and how these overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..functions.names import check_names, name_map
from ..functions.types import col_type


def summarize_columns(df: DataFrame) -> DataFrame:
    """(colname, type, n_unique) of each column; null counts as a value."""
    if not isinstance(df, DataFrame):
        raise InputError("`df` must be a DataFrame")
    names = check_names(name_map(df.columns), "df")
    counts = _distinct(df, None, {i: i for i in range(len(names))})
    rows = [(n.column, col_type(f.dataType), counts[i][0]) for i, (n, f) in enumerate(zip(names, df.schema))]
    return df.sparkSession.createDataFrame(rows, "colname string, type string, n_unique long")


def compare_columns(x: DataFrame, y: DataFrame) -> DataFrame:
    """A row for each column of either table, x's first: names, types, distinct values, and those in common.

    Values are compared where the types agree. One pass counts all columns of both tables.
    """
    if not isinstance(x, DataFrame) or not isinstance(y, DataFrame):
        raise InputError("`x` and `y` must be DataFrames")
    map_x, map_y = check_names(name_map(x.columns), "x"), check_names(name_map(y.columns), "y")
    at_y = {n.column: i for i, n in enumerate(map_y)}
    pairs = {i: at_y[n.column] for i, n in enumerate(map_x) if n.column in at_y}
    extra = [i for i, n in enumerate(map_y) if n.column not in {m.column for m in map_x}]
    place = {v: k for k, v in pairs.items()} | {i: len(map_x) + k for k, i in enumerate(extra)}
    counts = _distinct(x, y, place)
    rows = []
    for i, n in enumerate(map_x):
        type_x = col_type(x.schema[i].dataType)
        if i not in pairs:
            rows.append((n.column, n.name, None, type_x, None, None, counts[i][0], None, None, None, None))
            continue
        m = map_y[pairs[i]]
        type_y = col_type(y.schema[pairs[i]].dataType)
        ux, uy, both = counts[i]
        overlap = (None, None, None)
        if type_x == type_y:
            union = ux + uy - both
            overlap = (both, union, 100.0 * both / union if union else None)
        rows.append((n.column, n.name, m.name, type_x, type_y, type_x == type_y, ux, uy, *overlap))
    for k, i in enumerate(extra):
        m = map_y[i]
        rows.append((m.column, None, m.name, None, col_type(y.schema[i].dataType), None, None, counts[len(map_x) + k][1], None, None, None))
    schema = (
        "colname string, name_x string, name_y string, type_x string, type_y string, type_match boolean, "
        "n_unique_x long, n_unique_y long, n_common long, n_union long, over_pct double"
    )
    return x.sparkSession.createDataFrame(rows, schema)


def _cell(c: Column, kind: T.DataType) -> Column:
    """A value in at most 16 bytes that are equal just for equal values; null for null.

    Whole numbers, dates and truth values are their own digits. What is longer as
    text is represented by 128 bits of a hash.
    """
    match kind:
        case T.BooleanType() | T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return F.unhex(F.hex(c.cast("long")))
        case T.DateType():
            return F.unhex(F.hex(F.unix_date(c).cast("long")))
        case T.DoubleType() | T.FloatType():
            text = F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double")).cast("string")
        case T.ArrayType() | T.MapType() | T.StructType():
            text = F.to_json(F.struct(c.alias("v")))
        case T.BinaryType():
            text = F.base64(c)
        case _:
            text = c.cast("string")
    return F.when(F.octet_length(text) < 16, F.encode(text, "utf-8")).otherwise(F.unhex(F.md5(text)))


def _distinct(x: DataFrame, y: DataFrame | None, place: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each column's number: distinct values in x, in y, and in both. Columns of y are numbered by `place`.

    Every cell is at most 16 bytes and its column's number before it is shuffled,
    and each different one of a task is shuffled once.
    """
    kinds: dict[str, int] = {}

    def values(df: DataFrame, number: dict[int, int], side: int) -> DataFrame:
        inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        cells = [
            F.struct(F.lit(number[i]).alias("at"), F.lit(kinds.setdefault(col_type(f.dataType), len(kinds))).alias("kind"), _cell(F.col(f"c{i}"), f.dataType).alias("value"))
            for i, f in enumerate(df.schema)
        ]
        return inner.select(F.explode(F.array(*cells)).alias("c")).select("c.*", F.lit(side).alias("side"))

    cells = values(x, {i: i for i in range(len(x.columns))}, 1)
    numbers = range(len(x.columns))
    if y is not None:
        cells = cells.union(values(y, place, 2))
        numbers = range(max([len(x.columns), *(v + 1 for v in place.values())]))
    each = cells.groupBy("at", "kind", "value").agg(F.bit_or("side").alias("in"))
    of = lambda side: F.count_if(F.col("in").bitwiseAND(F.lit(side)) == side)
    rows = each.groupBy("at").agg(of(1), of(2), of(3)).collect()  # one for each column
    found = {r[0]: (r[1], r[2], r[3]) for r in rows}
    return {i: found.get(i, (0, 0, 0)) for i in numbers}
