"""The register of media files: adding files, listing them, and bringing it in line with the store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.ids import mime_from_extension, path_extension, path_folder
from docsieve.schema import MEDIA_TYPES
from docsieve.session import keep

KEY = ("index", "field", "filepath")
REGISTER = (
    "index string, field string, filepath string, path string, size bigint, content_type string, "
    "registered timestamp_ntz, last_synced timestamp_ntz"
)
# Fixed value: how long an upload link stays valid, in hours, plus one hour of grace.
PENDING_HOURS = 25


def object_total(register: DataFrame) -> DataFrame:
    """Bytes per project."""
    return register.groupBy("index").agg(F.sum("size").alias("total"))


def running_total(
    df: DataFrame, group: str, position: str, amount: str, total: str, peak: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Running sum of ``amount`` per group in order of ``position``, then ``ties``, and its highest value so far.

    Rows are laid out by ranges of group and position, and stored with the number of their range. Sums run inside
    the ranges first; what came before a range is added from the few range sums of its group. So a group that holds
    most rows is summed by as many tasks as it has ranges.
    """
    ranged = df.repartitionByRange(group, position, *ties).withColumn("__range", F.spark_partition_id())
    stored = keep(ranged, "ranges")
    inside = Window.partitionBy(group, "__range").orderBy(position, *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = stored.withColumn("__inside", F.sum(amount).over(inside))
    summed = summed.withColumn("__inside_peak", F.max("__inside").over(inside))
    ranges = summed.groupBy(group, "__range").agg(F.sum(amount).alias("__sum"), F.max("__inside").alias("__top"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    before = before.withColumn("__before_peak", F.max(F.col("__before") + F.col("__top")).over(earlier))
    both = summed.join(before.drop("__sum", "__top"), [group, "__range"])
    return both.withColumns(
        {
            total: F.col("__before") + F.col("__inside"),
            peak: F.greatest(F.col("__before_peak"), F.col("__before") + F.col("__inside_peak")),
        }
    ).drop("__range", "__inside", "__inside_peak", "__before", "__before_peak")


def quota_running(
    requests: DataFrame, register: DataFrame, max_bytes: int, position: str = "position", force: str | None = None
) -> DataFrame:
    """Requests that change something, with the size each adds and the project's running total.

    A known file counts by its difference in size, and one of the same size is skipped unless forced.
    ``within_quota`` holds up to the first request that takes the project over the limit.
    """
    known = register.select(*KEY, F.col("size").alias("old_size"))
    changed = F.col("old_size").isNull() | (F.col("old_size") != F.col("size"))
    if force:
        changed = changed | F.col(force)
    wanted = requests.join(known, list(KEY), "left").where(changed)
    wanted = wanted.withColumn("added", F.col("size") - F.coalesce("old_size", F.lit(0)))
    summed = running_total(wanted, "index", position, "added", "__total", "__peak", ["field", "filepath"])
    # One row per project on the right; Spark sends it everywhere when it is small, and splits hot keys if not.
    stored = object_total(register).withColumnRenamed("total", "__stored")
    base = F.coalesce("__stored", F.lit(0))
    return (
        summed.join(stored, "index", "left")
        .withColumns({"running_total": base + F.col("__total"), "within_quota": base + F.col("__peak") <= max_bytes})
        .drop("__stored", "__total", "__peak")
    )


@dataclass(frozen=True)
class Registered:
    """The new register, and refused requests with the reason."""

    register: DataFrame
    refused: DataFrame


def register_objects(
    register: DataFrame,
    requests: DataFrame,
    field_type: str,
    max_bytes: int,
    now: dt.datetime,
    position: str = "position",
    force: str | None = None,
) -> Registered:
    """Add new or changed files. A project whose requests hold one bad file, or exceed the quota, gets none of them."""
    if field_type not in MEDIA_TYPES:
        raise ValueError(f"{field_type} is not a media type")
    wanted = quota_running(requests, register, max_bytes, position, force)
    extension = path_extension(F.col("filepath"))
    given = F.col("content_type") if "content_type" in requests.columns else F.lit(None).cast("string")
    typed = wanted.withColumn("content_type", F.coalesce(given, mime_from_extension(extension)))
    reason = (
        F.when(F.col("content_type").isNull(), F.lit("unknown extension"))
        .when(~F.col("content_type").startswith(field_type), F.lit("type does not fit the field"))
        .when(~F.col("within_quota"), F.lit("over quota"))
    )
    # The judged requests decide about projects, make the new rows and give the reasons, so they are kept.
    judged = keep(typed.withColumn("reason", reason), "requests")
    bad_projects = judged.where("reason is not null").select("index").distinct()
    accepted = judged.join(bad_projects, "index", "left_anti")
    # A file asked for twice in one call is taken as the last request has it.
    last = Window.partitionBy(*KEY).orderBy(F.col(position).desc())
    latest = accepted.withColumn("__rank", F.row_number().over(last)).where("__rank <= 1")
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = latest.select(
        *KEY,
        path_folder(F.col("filepath")).alias("path"),
        F.col("size").cast("bigint").alias("size"),
        "content_type",
        moment.alias("registered"),
        F.lit(None).cast("timestamp_ntz").alias("last_synced"),
    )
    kept = register.join(rows.select(*KEY), list(KEY), "left_anti")
    return Registered(kept.unionByName(rows), judged.where("reason is not null").select(*KEY, "reason"))


def list_objects(
    register: DataFrame, index: str, directory: str = "", recursive: bool = False, contains: str | None = None
) -> DataFrame:
    """Files of a project: direct children of a directory, or the whole tree below it."""
    found = register.where(F.col("index") == index)
    folder = directory.strip("/")
    if not recursive:
        found = found.where(F.col("path") == folder)
    elif folder:
        found = found.where(F.col("filepath").startswith(folder + "/"))
    return found.where(F.col("filepath").contains(contains)) if contains else found


def split_key(key: Column) -> dict[str, Column]:
    """Project, field and file path from a store key ``project/field/path/to/file``."""
    return {
        "index": F.regexp_extract(key, r"(?s)^([^/]*)/([^/]*)/(.*)$", 1),
        "field": F.regexp_extract(key, r"(?s)^([^/]*)/([^/]*)/(.*)$", 2),
        "filepath": F.regexp_extract(key, r"(?s)^([^/]*)/([^/]*)/(.*)$", 3),
    }


def reconcile_objects(
    register: DataFrame, listing: DataFrame, now: dt.datetime, index: str | None = None, field: str | None = None
) -> DataFrame:
    """The register after a sync with the store listing ``(index, field, filepath, size)``.

    Listed files are added or refreshed. Others go, unless their upload may still be under way. A listing of one project,
    or of one field of it, is named by ``index`` and ``field``: entries and files outside of it are left as they are.
    """
    scope = F.lit(True)
    for name, value in (("index", index), ("field", field)):
        if value is not None:
            scope = scope & F.coalesce(F.col(name) == value, F.lit(False))
    if index is not None or field is not None:
        outside = register.where(~scope)
        synced = reconcile_objects(register.where(scope), listing.where(scope), now)
        return synced.unionByName(outside.select(*synced.columns))
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    pending_since = F.lit((now - dt.timedelta(hours=PENDING_HOURS)).isoformat(sep=" ")).cast("timestamp_ntz")
    found = listing.select(*KEY, F.col("size").alias("__size"), F.lit(True).alias("__listed"))
    both = register.join(found, list(KEY), "full_outer")
    listed = F.coalesce("__listed", F.lit(False))
    pending = F.coalesce(F.col("registered") > pending_since, F.lit(False))
    return both.where(listed | pending).select(
        *KEY,
        F.coalesce(F.col("path"), path_folder(F.col("filepath"))).alias("path"),
        F.coalesce(F.col("__size"), F.col("size")).alias("size"),
        "content_type",
        "registered",
        F.when(listed, moment).otherwise(F.col("last_synced")).alias("last_synced"),
    )


def delete_objects(register: DataFrame, index: str, field: str | None = None, filepaths=None) -> DataFrame:
    """Drop the entries of a project, of one of its fields, or of given files."""
    gone = F.col("index") == index
    if field is not None:
        gone = gone & (F.col("field") == field)
    if filepaths is not None:
        gone = gone & F.col("filepath").isin(list(filepaths))
    return register.where(~F.coalesce(gone, F.lit(False)))
