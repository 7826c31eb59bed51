"""Profiling and validating incoming tables of strings, in one aggregation pass over all columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.coerce import CHECKS, COERCERS, URL, coerce_number, is_boolean, is_date, is_number
from docsieve.functions.ids import link_type, path_extension
from docsieve.schema import MEDIA_TYPES
from docsieve.session import keep

# Shares and lengths of the type rules, and the number of examples shown.
MAX_INVALID = 0.2
MAX_DISTINCT = 0.5
MAX_KEYWORD_GUESS = 100
MAX_KEYWORD = 256
MAX_EXAMPLES = 100

# Size of the distinct sketch (its relative error is below 1 %), and the margin around the threshold in which
# values are counted exactly instead.
_SKETCH = 14
_MARGIN = 0.05


def _cells(df: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """One row per cell: the number of its column, and its value as text. Rules are then planned once, whatever
    the number of columns."""
    cells = [F.struct(F.lit(i).alias("column"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.*")


def _classes(cells: DataFrame) -> DataFrame:
    """Cells with what each may be. A cell is tried by each pattern at most once, and only if its start allows for it."""
    value, start = F.col("value"), F.ascii("value")
    digit = start.between(ord("0"), ord("9"))
    number = F.when(digit | (start == ord("-")), coerce_number(value))
    date = F.when(digit & (F.substring(value, 5, 1) == "-"), is_date(value))
    url = F.when(start == ord("h"), value.rlike(URL))
    boolean = F.when(F.length(value) <= len("false"), is_boolean(value))
    found = cells.select("column", "value", number.alias("number"), date.alias("date"), url.alias("url"), boolean.alias("boolean"))
    # Not merged into the select above, as `number` occurs twice.
    return found.withColumn("integer", F.col("number") == F.floor("number"))


def infer_types(df: DataFrame) -> DataFrame:
    """The field type each column most likely has; rows ``(column, type)``.

    All rules are counted in one pass. The distinct share, which only matters for short values, is estimated in
    that pass; columns whose estimate lies near the threshold are counted exactly in a second one.
    """
    names, value = df.columns, F.col("value")
    counts = (
        _classes(_cells(df, names))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("date")).alias("date"),
            F.count("number").alias("number"),
            F.count_if(F.col("integer")).alias("integer"),
            F.count_if(F.col("url")).alias("url"),
            F.count_if(F.col("boolean")).alias("boolean"),
            F.hll_sketch_estimate(F.hll_sketch_agg(value, _SKETCH)).alias("distinct"),
            F.count_if(value.isNull()).alias("null"),
            F.max(F.length(value)).alias("longest"),
            F.count_if(value.contains(" ")).alias("spaced"),
        )
    )
    # One row per column, so the driver gets no more than the schema is long.
    profile = {row["column"]: row for row in counts.collect()}
    if not profile:
        raise ValueError("types cannot be inferred from an empty table")
    rows = profile[0]["rows"]

    def share(i: int) -> float:
        return (profile[i]["distinct"] + (profile[i]["null"] > 0)) / rows

    def early(i: int) -> str | None:
        fits = profile[i]
        if (rows - fits["date"]) / rows < MAX_INVALID:
            return "date"
        if (rows - fits["number"]) / rows < MAX_INVALID:
            return "integer" if fits["integer"] == rows else "number"
        if fits["url"] == rows:
            return "url"
        if fits["boolean"] == rows:
            return "boolean"
        # Values without blanks are keywords whatever their distinct share.
        return "keyword" if fits["spaced"] == 0 else None

    found = [early(i) for i in range(len(names))]
    open_ = [i for i, kind in enumerate(found) if kind is None]
    short = [i for i in open_ if (profile[i]["longest"] or 0) <= MAX_KEYWORD_GUESS]
    distinct_share = {i: share(i) for i in short}
    unsure = [i for i in short if abs(share(i) - MAX_DISTINCT) <= _MARGIN]
    if unsure:
        exact = df.agg(*[F.count_distinct(F.col(names[i])).alias(f"d{i}") for i in unsure]).first()
        distinct_share.update({i: (exact[f"d{i}"] + (profile[i]["null"] > 0)) / rows for i in unsure})
    for i in open_:
        found[i] = "keyword" if i in distinct_share and distinct_share[i] < MAX_DISTINCT else "text"
    return df.sparkSession.createDataFrame(list(zip(names, found)), "column string, type string")


def misfit_link(value: Column, media_type: str) -> Column:
    """True for a local path whose extension does not fit the media type. Links to other sites are exempt."""
    kind = F.coalesce(link_type(path_extension(value)), F.lit(""))
    return ~value.rlike(r"^https?://") & ~kind.contains(media_type)


def _broken(value: Column, field_type: str, unsigned: bool) -> Column:
    """True for a value that breaks the rules of its type; never null."""
    if field_type in CHECKS:
        broken = ~CHECKS[field_type](value)
        return broken | F.coalesce(value.startswith("-"), F.lit(False)) if unsigned else broken
    if field_type == "keyword":
        broken = (F.length(value) > MAX_KEYWORD) | (value == "")
    elif field_type == "text":
        broken = value == ""
    elif field_type in MEDIA_TYPES:
        broken = misfit_link(value, field_type)
    else:
        return F.lit(False)
    return F.coalesce(broken, F.lit(False))


def _broken_cell(names: Sequence[str], types: Mapping[str, str], unsigned: Sequence[str]) -> Column:
    """The rule of its own column, for a row of ``_cells``; each rule is planned once per type."""
    column, value, cases = F.col("column"), F.col("value"), None
    kinds = {(types[n], n in unsigned) for n in names}
    for kind, flag in sorted(kinds):
        here = column.isin([i for i, n in enumerate(names) if (types[n], n in unsigned) == (kind, flag)])
        rule = _broken(value, kind, flag)
        cases = F.when(here, rule) if cases is None else cases.when(here, rule)
    return cases


def _named(names: Sequence[str], values: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(values[i]) for i in range(len(names))]), F.col("column") + 1)


def validate_columns(df: DataFrame, types: Mapping[str, str], unsigned: Sequence[str] = ()) -> DataFrame:
    """Status per column, with the number of values behind it; rows ``(column, type, status, problem, n)``.

    ``Type invalid``: values that will be skipped. ``Type warning``: all values look like numbers. Else ``Ready``.
    """
    names, value = list(types), F.col("value")
    # Only texts and keywords are tried as numbers, which is the costly test.
    as_text = F.col("column").isin([i for i, n in enumerate(names) if types[n] in ("text", "keyword")])
    counts = (
        _cells(df, names)
        .groupBy("column")
        .agg(
            F.count_if(F.coalesce(F.length(value) > MAX_KEYWORD, F.lit(False))).alias("long"),
            F.count_if(F.coalesce(value == "", F.lit(False))).alias("empty"),
            F.count_if(as_text & ~is_number(value)).alias("other"),
            F.count_if(_broken_cell(names, types, unsigned)).alias("broken"),
        )
    )
    kind = _named(names, [types[n] for n in names])
    texty = kind.isin("text", "keyword")
    problem = (
        F.when((kind == "keyword") & (F.col("long") > 0), F.lit("too long"))
        .when(texty & (F.col("empty") > 0), F.lit("empty"))
        .when(texty & (F.col("other") == 0), F.lit("all numeric"))
        .when(~texty & (F.col("broken") > 0), F.concat(F.lit("invalid "), kind))
        .otherwise(F.lit(""))
    )
    judged = counts.withColumns({"type": kind, "problem": problem, "name": _named(names, names)})
    found = F.col("problem")
    n = F.when(found == "too long", F.col("long")).when(found == "empty", F.col("empty"))
    status = F.when(found == "", F.lit("Ready")).when(found == "all numeric", F.lit("Type warning"))
    return judged.select(
        F.col("name").alias("column"),
        "type",
        status.otherwise(F.lit("Type invalid")).alias("status"),
        "problem",
        n.when(found.startswith("invalid"), F.col("broken")).otherwise(F.lit(0)).cast("bigint").alias("n"),
    )


def invalid_examples(
    df: DataFrame,
    types: Mapping[str, str],
    order: Sequence[str],
    size: int = MAX_EXAMPLES,
    unsigned: Sequence[str] = (),
) -> DataFrame:
    """The first ``size`` invalid values per column, in the given row order; rows ``(column, rank, value)``.

    Ranking keeps at most ``size`` rows per column and task before anything is shuffled.
    """
    names = [n for n in types if n not in order]
    wrong = _cells(df, names, *order).where(_broken_cell(names, types, unsigned))
    ranking = Window.partitionBy("column").orderBy(*order)
    ranked = wrong.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= size)
    return ranked.select(_named(names, names).alias("column"), "rank", "value")


def coerce_rows(df: DataFrame, types: Mapping[str, str], names: Mapping[str, str] | None = None) -> DataFrame:
    """Typed columns from strings; a value that does not convert is dropped. ``names`` renames columns."""
    names = names or {}
    columns = []
    for name, kind in types.items():
        value = COERCERS[kind](F.col(name)) if kind in COERCERS else F.col(name)
        columns.append(value.alias(names.get(name, name)))
    return df.select(*columns)


def find_duplicates(df: DataFrame, identifiers: Sequence[str] | None = None) -> DataFrame:
    """Identifier values that more than one row has, with the number of rows; all columns if none are given.

    Values of open length are first counted by a digest of 128 bits, which runs a job at once. Only values whose digest
    repeats are then grouped themselves, so that long texts that occur once are not shuffled.
    """
    keys = list(identifiers or df.columns)
    if any(_is_long(df.schema[k].dataType) for k in keys):
        # Hashes pass over nulls, so where they are counts as well.
        parts = [F.col(k) for k in keys] + [F.col(k).isNull() for k in keys]
        digest = F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("again"), *parts).alias("b"))
        counts = df.groupBy(digest.alias("__digest")).agg(F.count(F.lit(1)).alias("n"))
        repeated = keep(counts.where("n > 1").select("__digest"), "digests")
        df = df.withColumn("__digest", digest).join(repeated, "__digest", "left_semi").drop("__digest")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def _is_long(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def has_duplicates(df: DataFrame, identifiers: Sequence[str] | None = None) -> bool:
    return not find_duplicates(df, identifiers).isEmpty()


def missing_media(df: DataFrame, field: str, media_type: str, register: DataFrame, path: str = "filepath") -> DataFrame:
    """Local paths whose extension does not fit the field, or that the register lacks; rows ``(field, n)``.

    Paths are counted first, so one that fills much of the table reaches the lookup as a single row.
    """
    value = F.col(field)
    paths = df.where(~value.rlike(r"^https?://")).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    misfit = misfit_link(value, media_type)
    listed = register.select(F.col(path).alias(field))
    absent = paths.where(~misfit).join(listed, field, "left_anti")
    return paths.where(misfit).unionByName(absent)
