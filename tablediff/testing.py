"""An assertion for tests."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from .errors import DuplicatesError, DuplicatesWarning, InputError
from .operators.summary import diff_summary
from .plans.diff import DiffResult, diff_table
from .plans.report import kept

#: The square root of the distance between 1 and the next double.
DEFAULT_REL_TOL = 2.0**-26


class TableMismatch(AssertionError):
    """Two tables differ; `result` is the comparison."""

    def __init__(self, message: str, result: DiffResult):
        super().__init__(message)
        self.result = result


def assert_table_equal(actual: DataFrame, expected: DataFrame, *, rel_tol: float | None = None, max_rows: int = 10, **options) -> DiffResult:
    """Asserts that `actual` matches `expected`, the benchmark, within a tiny relative tolerance.

    Takes the options of diff_table(). Repeated keys are refused unless
    `duplicates` says how to treat them; as multisets values are compared exactly.
    """
    if isinstance(max_rows, bool) or not isinstance(max_rows, (int, float)) or not max_rows >= 0:
        raise InputError(f"max_rows={max_rows!r}: expected a number of 0 or more")
    if rel_tol is None:
        rel_tol = 0 if options.get("duplicates") == "aggregate" else DEFAULT_REL_TOL
    with warnings.catch_warnings():
        if "duplicates" not in options:
            warnings.simplefilter("error", DuplicatesWarning)
        try:
            d = diff_table(expected, actual, rel_tol=rel_tol, **options)
        except DuplicatesWarning as w:
            raise DuplicatesError(f'{w} Pass duplicates = "disambiguate" or "aggregate" to accept them.', duplicates=w.duplicates) from None
    with kept(d):
        off = d.differences()
        if not (n := off.count()):
            return d
        first = d.with_df(off).sorted().limit(int(min(max_rows, 10_000)))
        shown = first._show_string(int(min(max_rows, 10_000)), False) if max_rows else ""
        head = f"First {max_rows} records that differ:\n" if n > max_rows else ""
        message = f"the tables differ: {n:,} of {d.df.count():,} records.\n\n{diff_summary(d)._show_string(100, False)}\n{head}{shown}"
    raise TableMismatch(message, d)
