"""What several of these operators need: the notion of a word, row keys, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.session import CHECKPOINT_DIR, keep, shared_dir

__all__ = [
    "CHECKPOINT_DIR",
    "arrow_map",
    "keep",
    "remembered",
    "shared_dir",
    "slices",
    "table",
    "text_of",
    "word_count",
    "words_of",
]

# A word is a run of anything but these white space characters.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def words_of(text: Column) -> Column:
    """The words of a text, an empty list if it has none."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words: places where a word begins."""
    return F.regexp_count(text, F.lit(f"{WORD_CLASS}+")).cast("bigint")


_memory: dict[str, tuple] = {}


def remembered(kind: str, key, make: Callable):
    """What the tasks of one kind share that follow each other in a Python worker, made anew where ``key`` differs.

    A task of another kind frees it, see `arrow_map`.
    """
    held = _memory.get(kind)
    if held is None or held[0] != key:
        held = _memory[kind] = (key, make())
    return held[1]


def arrow_map(
    df: DataFrame,
    schema: str,
    each: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator | None]],
    kind: str | None = None,
) -> DataFrame:
    """Map Arrow batches. ``each`` runs once per task, so that models are loaded once, and gives the function.

    ``kind`` names what the tasks remember; what those of other kinds have left behind in the worker is freed.
    """

    def run(batches):
        for other in [k for k in _memory if k != kind]:
            del _memory[other]
        work = each()
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                if isinstance(made, pa.RecordBatch):
                    yield made
                elif made is not None:
                    yield from made

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``limit`` bytes of the text in column ``text``, so that Python objects stay few."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
