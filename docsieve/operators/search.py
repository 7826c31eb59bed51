"""Listing documents: fields, snippets, sorting and paging."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.snippets import present
from docsieve.operators.filters import select
from docsieve.operators.order import RANDOM, Sort, order_by
from docsieve.operators.scroll import behind, snapshot, with_id
from docsieve.schema import ID, Snippet

# Up to so many rows a page is cut from the first rows of the sort order, which one task holds; deeper ones are read from a
# snapshot of the order.
TOP_ROWS = 100_000


def sort_documents(df: DataFrame, sort: Any, seed: int = 0) -> DataFrame:
    return df.orderBy(*order_by(Sort.of(sort), seed=seed))


def _fields(fields: Any) -> dict[str, Snippet | None]:
    if fields is None:
        return {}
    if isinstance(fields, Mapping):
        return dict(fields)
    return dict.fromkeys(fields)


def project_fields(df: DataFrame, fields: Any = None) -> DataFrame:
    """``_id`` and the requested fields; only ``_id`` if none is given."""
    return df.select(ID, *[name for name in _fields(fields) if name != ID])


def search(
    df: DataFrame,
    queries=None,
    filters: Mapping[str, Any] | None = None,
    ids=None,
    fields: Any = None,
    sort: Any = None,
    page: int | None = 0,
    per_page: int = 10,
    highlight: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Matching documents, one page of them or (``page=None``) all.

    ``fields`` is a list of names, or a dict from name to a ``Snippet`` (None for the whole value). Snippets and
    marks are made after the page is cut, so only for the rows that are shown. A page behind the first TOP_ROWS rows is
    read from a snapshot, which is made at once; to read several such pages, make one `snapshot` and take them from it.
    """
    chosen = _fields(fields)
    keys = Sort.of(sort)
    found = select(df, queries, filters, ids)
    needed = dict.fromkeys([ID, *chosen, *[k.field for k in keys if k.field != RANDOM]])
    found = found.select(*needed)
    if page is not None:
        if (page + 1) * per_page > TOP_ROWS:
            found = snapshot(found, keys, seed).rows(page * per_page, per_page)
        else:
            found = found.orderBy(*order_by(keys, seed=seed)).offset(page * per_page).limit(per_page)
    elif keys:
        found = found.orderBy(*order_by(keys, seed=seed))
    shown = {name: params for name, params in chosen.items() if name != ID}
    return found.select(ID, *present(found, shown, queries, highlight))


def page_meta(df: DataFrame, per_page: int = 10, page: int = 0, queries=None, filters=None, ids=None) -> DataFrame:
    """Exact number of matching documents and of pages, in one row."""
    total = F.count(F.lit(1))
    return select(df, queries, filters, ids).agg(
        total.alias("total_count"),
        F.lit(per_page).alias("per_page"),
        F.ceil(total / F.lit(per_page)).alias("page_count"),
        F.lit(page).alias("page"),
    )


def next_batch(df: DataFrame, size: int, after: Mapping[str, Any] | None = None, sort: Any = None) -> DataFrame:
    """The next ``size`` rows behind the row ``after`` (a dict of its sort keys and id).

    Unlike a page number this costs the same at any depth: rows before the cursor are filtered, not counted.
    Rows without a key come last, as in every order, and are read like the others.
    """
    keys = with_id(sort)
    if after is not None:
        df = df.where(behind(keys, after))
    return df.orderBy(*order_by(keys)).limit(size)


def batches(df: DataFrame, size: int, sort: Any = None) -> Iterator[list[Any]]:
    """Batch after batch until the end, from a snapshot: one sort for all of them."""
    yield from snapshot(df, sort).batches(size)
