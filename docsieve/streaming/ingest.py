"""Taking document batches as they arrive.

Every micro-batch is stored under the id of its query and its own number, and then entered into a log, which numbers the
batches of all sources in the order in which they were taken. A batch that is in the log already is known: sent again, it
changes nothing, whatever other sources have sent meanwhile. One that was only stored in part is stored anew.

The table is the last base with the batches of the log behind it applied in order. `compact` writes a new base, so that
reading does not grow with the number of batches; `ingest` does so by itself when it is told where the batches go.
One process at a time takes batches into a folder; streams of one process may share it.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docsieve.operators.write import Written, write
from docsieve.schema import Field
from docsieve.session import delete_path, list_folders

_ORDER, _VERSION = "__order", "__version"
_LOG = "version bigint, query string, batch bigint"
_commits = threading.Lock()


@dataclass(frozen=True)
class Into:
    """Where taken batches go: a table, what is done with them, and how many may wait before they are applied."""

    stored: DataFrame
    operation: str = "upsert"
    fields: Mapping[str, str | Field] | None = None
    waiting: int = 20


@dataclass(frozen=True)
class _State:
    """The newest base (0: none yet), the batches taken since, and the last batch of each query before."""

    base: int
    taken: list[tuple[int, str, int]]
    before: dict[str, int]

    @property
    def version(self) -> int:
        return max([self.base, *(v for v, _, _ in self.taken)])

    def knows(self, query: str, batch: int) -> bool:
        return batch <= self.before.get(query, -1) or any((q, b) == (query, batch) for _, q, b in self.taken)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished folders ``version=N`` of a path."""
    names = list_folders(spark, path, finished=True)
    return sorted(int(name.removeprefix("version=")) for name in names if name.startswith("version="))


def _state(spark: SparkSession, staging: str) -> _State:
    """Read from the log: a row for each batch since the last base, and one for each query."""
    bases = _versions(spark, f"{staging}/marks")
    base, before = 0, {}
    if bases:
        base = bases[-1]
        before = {r["query"]: r["batch"] for r in spark.read.parquet(f"{staging}/marks/version={base}").collect()}
    newer = [f"{staging}/log/version={v}" for v in _versions(spark, f"{staging}/log") if v > base]
    rows = spark.read.schema(_LOG).parquet(*newer).collect() if newer else []
    return _State(base, sorted(tuple(r) for r in rows), before)


def _batch_path(staging: str, query: str, batch: int) -> str:
    return f"{staging}/batches/query={query}/batch={batch}"


def take(batch: DataFrame, staging: str, query: str, number: int, position: str | None = None) -> bool:
    """Store a batch and enter it into the log; False if it is known. ``position`` orders its documents."""
    spark = batch.sparkSession
    with _commits:
        state = _state(spark, staging)
        if state.knows(query, number):
            return False
        order = F.col(position) if position else F.monotonically_increasing_id()
        rows = batch.withColumn(_ORDER, order.cast("bigint"))
        rows.write.mode("overwrite").parquet(_batch_path(staging, query, number))
        entry = spark.createDataFrame([(state.version + 1, query, number)], _LOG)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{staging}/log/version={state.version + 1}")
    return True


def watch_documents(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet") -> DataFrame:
    """Documents of the files that appear at a path."""
    return spark.readStream.schema(schema).format(file_format).load(path)


def ingest(
    documents: DataFrame,
    staging: str,
    checkpoint: str,
    position: str | None = None,
    every: str | None = None,
    into: Into | None = None,
) -> StreamingQuery:
    """Start taking batches; returns the running query. ``position`` orders documents inside a batch, else their place
    in its files does.

    It stops after what is there now, or goes on and looks ``every`` so often (as in "1 minute"). With ``into``, batches
    are applied when enough of them wait.
    """

    def store(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        take(batch, staging, query, number, position)
        # A batch sent again after a failure may have been taken, but not applied.
        if into is not None and len(_state(batch.sparkSession, staging).taken) >= into.waiting:
            compact(into.stored, staging, into.operation, into.fields)

    return (
        documents.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def _folded(stored: DataFrame, staging: str, state: _State, operation: str, fields) -> Written:
    spark = stored.sparkSession
    start = spark.read.parquet(f"{staging}/base/version={state.base}") if state.base else stored
    if not state.taken:
        return Written(start, start.select("_id").where(F.lit(False)))
    paths = [_batch_path(staging, query, batch) for _, query, batch in state.taken]
    # The batches that wait are few; their numbers go into the plan.
    waiting = spark.createDataFrame(state.taken, _LOG).withColumnRenamed("version", _VERSION)
    rows = spark.read.option("basePath", f"{staging}/batches").option("mergeSchema", True).parquet(*paths)
    rows = rows.withColumns({"query": F.col("query").cast("string"), "batch": F.col("batch").cast("bigint")})
    placed = rows.join(F.broadcast(waiting), ["query", "batch"])
    incoming = placed.withColumn("__place", F.struct(_VERSION, _ORDER)).drop("query", "batch", _VERSION, _ORDER)
    return write(operation, start, incoming, fields, position="__place")


def fold(
    stored: DataFrame, staging: str, operation: str = "upsert", fields: Mapping[str, str | Field] | None = None
) -> Written:
    """The project with all taken batches applied in the order of the log. ``stored`` counts until there is a base."""
    return _folded(stored, staging, _state(stored.sparkSession, staging), operation, fields)


def compact(
    stored: DataFrame, staging: str, operation: str = "upsert", fields: Mapping[str, str | Field] | None = None
) -> int:
    """Apply the waiting batches: write the next base, and return its version.

    The batches before it are not read any more. They, and older bases, are deleted by the next call, so that whoever
    reads while this one runs can go on.
    """
    spark = stored.sparkSession
    with _commits:
        state = _state(spark, staging)
        if not state.taken:
            return state.base
        version = state.version
        _folded(stored, staging, state, operation, fields).table.write.mode("overwrite").parquet(
            f"{staging}/base/version={version}"
        )
        last = state.before | {}
        for _, query, batch in state.taken:
            last[query] = max(batch, last.get(query, -1))
        marks = spark.createDataFrame(sorted(last.items()), "query string, batch bigint")
        marks.coalesce(1).write.mode("overwrite").parquet(f"{staging}/marks/version={version}")
        for old in _versions(spark, f"{staging}/log"):
            if old <= state.base:
                row = spark.read.schema(_LOG).parquet(f"{staging}/log/version={old}").first()
                delete_path(spark, _batch_path(staging, row["query"], row["batch"]))
                delete_path(spark, f"{staging}/log/version={old}")
        for part in ("base", "marks"):
            for old in _versions(spark, f"{staging}/{part}"):
                if old < state.base:
                    delete_path(spark, f"{staging}/{part}/version={old}")
    return version
