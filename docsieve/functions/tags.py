"""Adding and removing one tag of an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _holds(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def tag_add(tags: Column, tag: str) -> Column:
    """Without tags: a list of one; with the tag: as it is; else the tag comes last."""
    added = F.array_append(tags, F.lit(tag))
    return F.when(tags.isNull(), F.array(F.lit(tag))).when(_holds(tags, tag), tags).otherwise(added)


def tag_remove(tags: Column, tag: str) -> Column:
    """All copies of the tag go; an empty list becomes null."""
    left = F.array_remove(tags, tag)
    return F.when(F.size(left) > 0, left)


def tag_add_changes(tags: Column, tag: str) -> Column:
    return ~_holds(tags, tag)


def tag_remove_changes(tags: Column, tag: str) -> Column:
    """A document with any tags counts as written, whether or not it has this one."""
    return tags.isNotNull()
