"""The order of documents: sort keys, a random order that stays, and ties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.schema import ID

RANDOM = "?"


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False

    @staticmethod
    def of(spec: Any) -> list[Sort]:
        """Sort keys from a name, a list of names, or ``{field: {"order": "desc"}}`` items."""
        if spec is None:
            return []
        if isinstance(spec, (str, Sort, Mapping)):
            spec = [spec]
        keys = []
        for item in spec:
            if isinstance(item, Sort):
                keys.append(item)
            elif isinstance(item, str):
                keys.append(Sort(item))
            else:
                for name, options in item.items():
                    order = options if isinstance(options, str) else options.get("order", "asc")
                    if order not in ("asc", "desc"):
                        raise ValueError(f"unknown order {order!r}")
                    keys.append(Sort(name, order == "desc"))
        return keys


def random_key(seed: int, id_column: str = ID) -> Column:
    """A shuffled order that a re-run task or a later page gives again: a digest of id and seed."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def order_by(sort: Sequence[Sort], id_column: str = ID, seed: int = 0) -> list[Column]:
    """Sort columns; documents without a key come last, and the id settles ties."""
    columns = []
    for key in sort:
        column = random_key(seed, id_column) if key.field == RANDOM else F.col(key.field)
        columns.append(column.desc_nulls_last() if key.descending else column.asc_nulls_last())
    if id_column not in [key.field for key in sort]:
        columns.append(F.col(id_column).asc())
    return columns
