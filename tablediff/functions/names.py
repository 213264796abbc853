"""Column names in the form in which two tables are matched."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ColumnsError, listed


def canonical_name(name: str) -> str:
    """Upper case; whatever is not A-Z or 0-9 becomes one underscore, none at the ends."""
    upper = "".join(c.upper() if len(c.upper()) == 1 else c for c in name)
    return re.sub(r"[^A-Z0-9]+", "_", upper).strip("_")


@dataclass(frozen=True)
class Name:
    """A column's own name, its canonical one, and how messages call it."""

    name: str
    column: str

    @property
    def label(self) -> str:
        return self.name if self.name.upper() == self.column else f"{self.name} ({self.column})"


def name_map(columns: list[str]) -> list[Name]:
    return [Name(c, canonical_name(c)) for c in columns]


def check_names(names: list[Name], side: str, only: set[str] | None = None) -> list[Name]:
    """Refuses columns without a canonical name and different columns with the same one (of `only`, if given)."""
    empty = [n.name for n in names if not n.column] if only is None else []
    groups: dict[str, list[str]] = {}
    for n in names:
        if n.column and (only is None or n.column in only):
            groups.setdefault(n.column, []).append(n.name)
    clash = {k: v for k, v in groups.items() if len(v) > 1}
    problems = []
    if empty:
        problems.append(f"nothing is left of the name(s) {listed(repr(e) for e in empty)}")
    problems += [f"{listed(v)} all become {k}" for k, v in clash.items()]
    if problems:
        raise ColumnsError(f"`{side}`: " + "; ".join(problems), columns=[*empty, *(c for v in clash.values() for c in v)])
    return names
