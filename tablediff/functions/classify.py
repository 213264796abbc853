"""How two values, or two groups of them, differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In this order.
STATUS = ("same", "changed", "only_x", "only_y")

# Expressions are SQL texts: making them from columns takes a call to the JVM for each part, longer than a small comparison.


def finite_sql(v: str) -> str:
    return f"coalesce(NOT isnan({v}) AND abs({v}) <> double('Infinity'), false)"


def finite_pair(x: Column, y: Column) -> Column:
    """Both values themselves are finite, whatever their difference is."""
    return F.coalesce(~F.isnan(x) & ~F.isnan(y) & (F.greatest(F.abs(x), F.abs(y)) != float("inf")), F.lit(False))


def relative_sql(x: str, y: str) -> str:
    """The difference relative to the larger value, at most 2; null unless both are finite. Cannot overflow."""
    larger = f"greatest(abs({x}), abs({y}))"
    divided = f"abs({y} / nullif({larger}, 0D) - {x} / nullif({larger}, 0D))"
    return f"IF({finite_sql(x)} AND {finite_sql(y)}, IF({larger} = 0D, 0D, {divided}), NULL)"


def same_value_sql(x: str, y: str, tolerance: float, rel_tol: float, nan_is_na: bool) -> str:
    """Both missing, or equal, or finite and within one of the tolerances."""
    missing = f"({x} IS NULL OR isnan({x})) AND ({y} IS NULL OR isnan({y}))" if nan_is_na else f"{x} <=> {y}"
    near = [f"abs({y} - {x}) <= double('{float(tolerance)!r}')"] * bool(tolerance) + [f"{relative_sql(x, y)} <= double('{float(rel_tol)!r}')"] * bool(rel_tol)
    within = f" OR coalesce({finite_sql(x)} AND {finite_sql(y)} AND ({' OR '.join(near)}), false)" if near else ""
    return f"({missing}) OR coalesce({x} = {y}, false){within}"


def status_sql(in_x: str, in_y: str, same: str) -> str:
    """Presence decides first, then equality."""
    return f"CASE WHEN {in_x} IS NULL THEN 'only_y' WHEN {in_y} IS NULL THEN 'only_x' WHEN {same} THEN 'same' ELSE 'changed' END"
