"""Search text as a predicate."""

from pyspark.sql import Column


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive LIKE '%text%'. % and _ in the text stay wildcards, a backslash is itself."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def names_or_equals(name: Column, identifier: Column, text: str) -> Column:
    return contains_text(name, text) | (identifier == text)
