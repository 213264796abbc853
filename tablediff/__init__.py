"""tablediff: compare two tables value by value, on Spark."""

from .errors import (
    CastError,
    ColumnsError,
    DiffError,
    DisjointError,
    DuplicatesError,
    DuplicatesWarning,
    InputError,
    KeysError,
    MeasuresError,
    Note,
    TypesError,
)
from .functions.cast import normalize_types
from .functions.types import cast_rules
from .operators.columns import compare_columns, summarize_columns
from .operators.keys import aggregate_by_key, duplicate_keys, merge_dry_run, merge_tables
from .operators.measures import melt
from .operators.rows import number_rows, occurrence, virtual_key
from .plans.diff import DiffResult, diff_table
from .operators.summary import diff_summary
from .plans.report import DiffReport, diff_report
from .testing import TableMismatch, assert_table_equal
