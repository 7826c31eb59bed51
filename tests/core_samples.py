"""What the tests of the library share: how results are read back."""

from __future__ import annotations


def ids(df) -> list[str]:
    return sorted(row["_id"] for row in df.select("_id").collect())


def values(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]


def as_dict(df) -> dict:
    """Bucket rows with one or more keys, as key -> last column."""
    return {(row[0] if len(row) == 2 else tuple(row[:-1])): row[-1] for row in df.collect()}
