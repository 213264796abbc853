"""What the engine refuses, warns of and notes."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger("tablediff")


class DiffError(ValueError):
    """A refusal; what it is about is in attributes."""

    def __init__(self, message: str, **fields: Any):
        super().__init__(message)
        self.__dict__.update(fields)


class InputError(DiffError):
    """An argument has no valid value."""


class ColumnsError(DiffError):
    """Columns are missing, unnamed, ambiguous or left over (`columns`)."""


class TypesError(DiffError):
    """Columns have types that cannot be compared (`columns`)."""


class CastError(DiffError):
    """A value cannot be converted (`column`, `from_type`, `to_type`, `examples`)."""


class KeysError(DiffError):
    """There is no key, or keys are not one to one (`dry_run`)."""


class MeasuresError(DiffError):
    """`measures` names no measures (`columns`)."""


class DuplicatesError(DiffError):
    """Keys repeat (`duplicates`, a DataFrame of them)."""


class DisjointError(DiffError):
    """No row aligns (`dry_run`)."""


class DuplicatesWarning(UserWarning):
    """Repeated keys were paired in order of their rows (`duplicates`)."""

    def __init__(self, message: str, duplicates: Any = None):
        super().__init__(message)
        self.duplicates = duplicates


@dataclass(frozen=True)
class Note:
    """Something worth knowing about a comparison: dropped_columns, ignored_columns, no_measures, truncation or repeated_keys."""

    kind: str
    message: str
    columns: tuple[str, ...] = field(default=())


def listed(names, most: int = 10) -> str:
    """Names in a row, a few of them if there are many."""
    names = [str(n) for n in names]
    if not names:
        return "<none>"
    rest = len(names) - most
    return ", ".join(names[:most]) + (f", ... ({rest} more)" if rest > 0 else "")
