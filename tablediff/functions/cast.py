"""Strict conversions as column expressions, each with what it refuses and what it truncates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CastError, InputError
from .types import CAST_FROM, RULES

INT_MAX = 2147483647
EXACT = float(2**53)
LOGICAL = {"TRUE": True, "T": True, "true": True, "True": True, "FALSE": False, "F": False, "false": False, "False": False}

# strptime's directives as Spark's date patterns have them.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "H": "HH", "M": "mm", "S": "ss", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def date_pattern(date_format: str) -> str:
    """Spark's pattern for a strptime format."""
    if not isinstance(date_format, str):
        raise InputError("`date_format` must be a format string")
    out, at = "", 0
    while at < len(date_format):
        c = date_format[at]
        if c == "%":
            at += 1
            d = date_format[at : at + 1]
            if d != "%" and d not in DIRECTIVES:
                raise InputError(f"`date_format` has an unknown directive: %{d}")
            out += "%" if d == "%" else DIRECTIVES[d]
        elif c.isalpha():
            stop = at
            while date_format[stop : stop + 1].isalpha():
                stop += 1
            out += f"'{date_format[at:stop]}'"
            at = stop - 1
        elif c in "'[]{}#":
            out += "''" if c == "'" else f"'{c}'"
        else:
            out += c
        at += 1
    return out


@dataclass
class Conversion:
    """`out` is the converted value, `refused` the conditions with the reason for each, `lost` where something is truncated.

    `steps` are columns that these need, each a projection over the one before;
    what is read from a text is in one, so that it is read once a row however
    many conditions look at it.
    """

    out: Column
    refused: list[tuple[Column, str]] = field(default_factory=list)
    lost: Column | None = None
    lost_why: str = ""
    steps: list[dict[str, Column]] = field(default_factory=list)


def number_text(v: Column, digits: Column) -> Column:
    """A double as text: fixed notation with up to 15 significant digits in [1e-15, 2^53), else scientific. digits: its %.14e."""
    size = F.abs(v)
    scientific = F.regexp_replace(digits, r"\.?0+e", "e")
    # A decimal is padded to its type's scale, so it is trimmed. Of small ones the text may have an exponent.
    fixed = F.when(size >= 1, digits.try_cast("decimal(38,14)").cast("string")).otherwise(digits.try_cast("decimal(38,30)").cast("string"))
    trimmed = F.regexp_replace(fixed, r"\.?0*$", "")
    return (
        F.when(v.isNull(), None)
        .when(F.isnan(v), "NaN")
        .when(F.abs(v) == float("inf"), F.when(v > 0, "Inf").otherwise("-Inf"))
        .when(v == 0, "0")
        .when((size >= 1e-15) & (size < EXACT) & ~fixed.contains("E"), trimmed)
        .otherwise(scientific)
    )


#: A hexadecimal number: its digits before and after the point, and the power of two.
HEXADECIMAL = r"^[+-]?0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?[0-9]+))?$"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPACE = " \t\n\x0b\x0c\r"


def read_number(c: str) -> list[dict[str, Column]]:
    """Steps that read a text column as a double: decimal or hexadecimal (up to 16 digits), Inf and NaN, white space around it; else null.

    The last one is called `<c>_d`. A text is looked at for hexadecimal digits
    only if it has an x.
    """
    t, h = F.col(f"{c}_t"), F.col(f"{c}_h")
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    hexadecimal = F.lower(t).contains("x") & t.rlike(HEXADECIMAL)
    # Up to 16 digits are whole numbers of 64 bits; the power of two is applied in halves, as one alone may be beyond a double.
    digits = F.ltrim(F.concat(h[0], h[1]), F.lit("0"))
    given = F.when(h[2] == "", 0).otherwise(F.coalesce(h[2].try_cast("int"), F.when(h[2].startswith("-"), -4000).otherwise(4000)))
    power = F.greatest(F.lit(-4000), F.least(F.lit(4000), given)) - 4 * F.length(h[1])
    half = F.floor(power / 2)
    whole = F.coalesce(F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).try_cast("double"), F.lit(0.0))
    number = (
        F.when(h.isNotNull(), F.when((F.length(h[0]) + F.length(h[1]) > 0) & (F.length(digits) <= 16), sign * whole * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)))
        .when(t.rlike(DECIMAL), t.try_cast("double"))
        .when(F.lower(t).isin(*[s + n for s in ("", "+", "-") for n in ("inf", "infinity")]), sign * float("inf"))
        .when(F.lower(t).isin("nan", "+nan", "-nan"), F.lit(float("nan")))
    )
    return [
        {f"{c}_t": F.btrim(F.col(c), F.lit(SPACE))},
        {f"{c}_h": F.when(hexadecimal, F.split(F.regexp_replace(t, HEXADECIMAL, "$1,$2,$3"), ","))},
        {f"{c}_d": number},
    ]


def text_number(df: DataFrame, c: str, name: str) -> DataFrame:
    """Adds the number that a text column says, or null."""
    for step in read_number(c):
        df = df.withColumns(step)
    return df.withColumnRenamed(f"{c}_d", name).drop(f"{c}_t", f"{c}_h")


def _integer(v: Column, nan_is_na: bool) -> Conversion:
    """A double as an integer, toward zero."""
    n = F.when(~F.isnan(v), v)
    fits = F.abs(n) <= INT_MAX
    refused = [(F.abs(n) > INT_MAX, f"an integer ends at {INT_MAX}")]
    if not nan_is_na:
        refused.insert(0, (F.isnan(v), "NaN has no such form (nan_is_na = False)"))
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
    return Conversion(F.when(fits, whole.cast("int")), refused, F.coalesce(fits & (n != whole), F.lit(False)), "a fraction would go")


def conversion(c: str, source: str, target: str, date_format: str = "%Y-%m-%d", nan_is_na: bool = True) -> Conversion:
    """How the column `c` of type `source` becomes one of type `target`; the rules must allow it."""
    v, pattern = F.col(c), date_pattern(date_format)
    if source == target:
        return Conversion(v)
    if source == "integer64":
        if target == "character":
            return Conversion(v.cast("string"))
        d = v.cast("double")
        exact = (F.abs(d) >= EXACT, "a double holds whole numbers below 2^53 only")
        if target == "numeric":
            return Conversion(d, [exact])
        inner = _integer(d, nan_is_na)
        return Conversion(inner.out, [exact, *inner.refused], inner.lost, inner.lost_why)
    if source == "character":
        if target == "logical":
            out = F.when(v.isin([k for k, x in LOGICAL.items() if x]), True).when(v.isin([k for k, x in LOGICAL.items() if not x]), False)
            return Conversion(out, [(v.isNotNull() & out.isNull(), "says neither true nor false")])
        if target == "Date":
            d, same = F.col(f"{c}_d"), F.col(f"{c}_s")
            steps = [{f"{c}_d": F.when(v.isNotNull(), F.try_to_date(v, pattern))}, {f"{c}_s": (F.date_format(d, pattern) == v) & (F.year(d) >= 1000)}]
            return Conversion(F.when(same, d), [(v.isNotNull() & d.isNull(), f"does not read as {date_format}"), (d.isNotNull() & ~same, f"is not how {date_format} writes this date")], steps=steps)
        d = F.col(f"{c}_d")
        bad = (v.isNotNull() & d.isNull(), "does not read as a number")
        if target == "numeric":
            return Conversion(d, [bad], steps=read_number(c))
        inner = _integer(d, nan_is_na)
        return Conversion(inner.out, [bad, *inner.refused], inner.lost, inner.lost_why, read_number(c))
    if target == "character":
        if source == "Date":
            return Conversion(F.date_format(v, pattern))
        if source == "numeric":
            text = F.col(f"{c}_s")
            off = ~F.isnan(v) & (F.abs(v) != float("inf")) & ~F.coalesce(text.try_cast("double") == v, F.lit(False))
            steps = [{f"{c}_e": F.format_string("%.14e", v)}, {f"{c}_s": number_text(v.cast("double"), F.col(f"{c}_e"))}]
            return Conversion(text, [(off, "15 digits give another number")], steps=steps)
        return Conversion(F.upper(v.cast("string")) if source == "logical" else v.cast("string"))
    seconds = F.unix_micros(v.cast("timestamp")) / F.lit(1e6) if source == "POSIXct" else None
    if target == "integer":
        if source == "Date":
            return Conversion(F.unix_date(v))
        return Conversion(v.cast("int")) if source == "logical" else _integer(v if source == "numeric" else seconds, nan_is_na)
    if target == "numeric":
        return Conversion(F.unix_date(v).cast("double") if source == "Date" else seconds if source == "POSIXct" else v.cast("double"))
    if source == "POSIXct":
        clock = (F.hour(v) != 0) | (F.minute(v) != 0) | (F.extract(F.lit("SECOND"), v) != 0)
        return Conversion(v.cast("date"), [], F.coalesce(clock, F.lit(False)), "the hour would go")
    d = v.cast("double")
    n = F.when(~F.isnan(d), d)
    fits = F.abs(n) <= INT_MAX
    refused = [(F.abs(n) > INT_MAX, "no such day")]
    if not nan_is_na:
        refused.insert(0, (F.isnan(d), "NaN has no such form (nan_is_na = False)"))
    day = F.floor(n)
    return Conversion(F.when(fits, F.date_from_unix_date(day.cast("int"))), refused, F.coalesce(fits & (n != day), F.lit(False)), "a part of a day would go")


@dataclass
class Truncation:
    """A column of which a cast truncated `n` values, with up to three examples."""

    column: str
    n: int
    examples: str


def check_rule(label: str, source: str, target: str) -> None:
    if source == target:
        return
    if source not in CAST_FROM:
        why = "unsupported source type"
    else:
        allowed, note = RULES.get((source, target), (False, "no rule for this pair"))
        if allowed:
            return
        why = note
    raise CastError(f"column {label}: {source} -> {target}, {why}", column=label, from_type=source, to_type=target, examples=[])


class Cast:
    """The conversion of `columns` (name: label, source, target) of a table, all together or refused.

    prepared() adds what is read from the values, once a row. `sums` are counts
    of what is refused and truncated, for whatever job reads the table next;
    judged() looks at them and refuses, or tells what is truncated; finished()
    gives the converted table.
    """

    def __init__(self, columns: dict[str, tuple[str, str, str]], date_format: str = "%Y-%m-%d", nan_is_na: bool = True):
        for label, source, target in columns.values():
            check_rule(label, source, target)
        self.columns = columns
        self.plans = {c: conversion(c, s, t, date_format, nan_is_na) for c, (_, s, t) in columns.items() if s != t}
        self.sums: dict[str, Column] = {}
        for c, p in self.plans.items():
            for k, (bad, _) in enumerate(p.refused):
                self.sums[f"bad|{c}|{k}"] = self._flag(bad)
            if p.lost is not None:
                self.sums[f"lost|{c}"] = self._flag(p.lost)
            self.sums[f"null|{c}"] = self._flag(self._nulled(c))

    @staticmethod
    def _flag(where: Column) -> Column:
        return F.coalesce(where, F.lit(False)).cast("long")

    def _nulled(self, c: str) -> Column:
        """A value becomes null though no rule refuses it; NaN may."""
        _, source, target = self.columns[c]
        number = F.col(c) if source == "numeric" else F.col(f"{c}_d") if (source, target) == ("character", "integer") else None
        folds = F.coalesce(F.isnan(number), F.lit(False)) if number is not None else F.lit(False)
        return F.col(c).isNotNull() & ~folds & self.plans[c].out.isNull()

    def prepared(self, df: DataFrame) -> DataFrame:
        depth = max([0, *(len(p.steps) for p in self.plans.values())])
        for k in range(depth):
            df = df.withColumns({n: v for p in self.plans.values() if k < len(p.steps) for n, v in p.steps[k].items()})
        return df

    def _examples(self, df: DataFrame, row_id: str, which: dict[str, tuple[Column, Column]]) -> dict[str, list[tuple]]:
        """Up to three different values of each column for which a condition holds, in order of the rows, by one job."""
        cells = [F.when(F.coalesce(where, F.lit(False)), F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"), shown.cast("string").alias("s"))) for c, (where, shown) in which.items()]
        found = df.select(F.col(row_id).alias("at"), F.explode(F.array_compact(F.array(*cells))).alias("e")).groupBy("e.c", "e.v", "e.s").agg(F.min("at").alias("at"))
        first = found.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("at"))).where("n <= 3").collect()
        return {c: [(r["v"], r["s"]) for r in sorted(first, key=lambda r: r["n"]) if r["c"] == c] for c in which}

    def judged(self, df: DataFrame, row_id: str, counts: dict[str, int], truncate: bool = True) -> tuple[list[Truncation], DataFrame | None]:
        """From the counts of `sums` over the prepared table: the truncations and the truncated rows (column, row_id_y), or a refusal."""

        def refuse(c: str, why: str, where: Column) -> None:
            label, source, target = self.columns[c]
            values = [str(v) for v, _ in self._examples(df, row_id, {c: (where, F.lit(None))})[c]]
            raise CastError(f"column {label}: {source} -> {target}, {why}: {', '.join(values)}", column=label, from_type=source, to_type=target, examples=values)

        for c, p in self.plans.items():
            for k, (bad, why) in enumerate(p.refused):
                if counts.get(f"bad|{c}|{k}"):
                    refuse(c, why, bad)
            if not truncate and counts.get(f"lost|{c}"):
                refuse(c, f"{p.lost_why} (truncate = False)", p.lost)
            if counts.get(f"null|{c}"):
                refuse(c, "nothing is left of it", self._nulled(c))
        lost = {c: (p.lost, p.out) for c, p in self.plans.items() if counts.get(f"lost|{c}")}
        if not lost:
            return [], None
        pairs = self._examples(df, row_id, lost)
        truncated = [Truncation(self.columns[c][0], counts[f"lost|{c}"], ", ".join(f"{a} -> {b}" for a, b in pairs[c])) for c in lost]
        names = [F.when(where, F.lit(self.columns[c][0])) for c, (where, _) in lost.items()]
        return truncated, df.select(F.explode(F.array_compact(F.array(*names))).alias("column"), F.col(row_id).cast("long").alias("row_id_y"))

    def finished(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select(*[self.plans[c].out.alias(c) if c in self.plans else F.col(c) for c in columns])


def normalize_types(df: DataFrame, to: dict[str, str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Converts the columns of `df` whose types cannot be compared, as `to` says for each type.

    Types may have Spark's names (bigint, timestamp). Every such column without
    an entry in `to` is refused; what truncating conversions drop is not recorded.
    """
    from ..errors import ColumnsError, TypesError, listed
    from .types import ALIASES, CAST_TYPES, col_type

    if not isinstance(df, DataFrame):
        raise InputError("`df` must be a DataFrame")
    to = {ALIASES.get(k, k): ALIASES.get(v, v) for k, v in ({"factor": "character"} if to is None else to).items()}
    cols = list(df.columns) if cols is None else list(cols)
    if unknown := [c for c in cols if c not in df.columns]:
        raise ColumnsError(f"unknown column(s): {listed(unknown)}", columns=unknown)
    types = {f.name: col_type(f.dataType) for f in df.schema}
    need = [c for c in cols if types[c] not in CAST_TYPES]
    if unmapped := [c for c in need if types[c] not in to]:
        raise TypesError("no conversion given for column(s): " + ", ".join(f"{c} ({types[c]})" for c in unmapped) + "; name the target type in `to`", columns=unmapped)
    if not need:
        return df
    inner = [f"c{i}" for i in range(len(df.columns))]
    named = dict(zip(df.columns, inner))
    cast = Cast({named[c]: (c, types[c], to[types[c]]) for c in need})
    work = cast.prepared(df.toDF(*inner).withColumn("__row", F.monotonically_increasing_id()))
    counts = {k: v or 0 for k, v in work.agg(*[F.sum(v).alias(k) for k, v in cast.sums.items()]).first().asDict().items()}
    cast.judged(work, "__row", counts)
    return cast.finished(work, inner).toDF(*df.columns)
