"""Names of columns that may hold any character."""

from __future__ import annotations


def quoted(name: str) -> str:
    """A column's name as col() and SQL take it: dots are part of it, backticks are doubled."""
    return "`" + name.replace("`", "``") + "`"
