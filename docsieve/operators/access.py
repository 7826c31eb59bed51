"""Who may see what: the strongest role rule per user and project, and the fields a role may read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.snippets import present
from docsieve.operators.filters import select
from docsieve.schema import ID, Field, Snippet

# Roles and their rank.
ROLES = {"NONE": 0, "OBSERVER": 10, "METAREADER": 20, "READER": 30, "WRITER": 40, "ADMIN": 50}
SERVER = "_server"

# Rules for everyone, or for a domain, meet very many users. Those of a domain are spread over one copy of its rules per
# so many users, those without rules for their domain over a fixed number of copies.
_USERS_PER_COPY = 4096
_SPREAD = 128


def role_rank(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in ROLES.items() for x in item])
    return F.try_element_at(table, role)


def role_name(rank: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, r in ROLES.items() for x in (r, n)]), rank)


def effective_role(
    users: DataFrame,
    rules: DataFrame,
    caps: DataFrame | None = None,
    min_role: str | None = None,
    contexts: Sequence[str] | None = None,
) -> DataFrame:
    """Role per user and project: exact address before ``*@domain`` before ``*``; rows ``(email, role_context, role)``.

    There is a row for every user in every project with a rule for everyone, so ask for the users and ``contexts``
    (projects) that are needed; for all of them at once there is `role_rules`. ``rules`` may be its result. ``caps`` holds key restrictions ``(email, server_role, default_project_role, project_roles map)``.
    The strongest rule is chosen first and then tested against ``min_role``.
    """
    if contexts is not None:
        rules = rules.where(F.col("role_context").isin(*contexts))
    # In a struct, a project without a name is equal to itself.
    project = F.struct("role_context").alias("project")
    offered = rules.select("email", project, role_rank(F.col("role")).alias("rank"))
    asked = users.select("email").distinct()
    # Both sides grow with the users, so neither is to be broadcast. All that follows keeps their order by address.
    exact = asked.join(offered.hint("merge"), "email").groupBy("email", "project").agg(F.max("rank").alias("rank"))
    settled = exact.where("rank is not null").groupBy("email").agg(F.collect_list("project").alias("settled"))
    people, known = asked.join(settled.hint("merge"), "email", "left"), exact.where("rank is not null")
    if caps is not None:
        people, known = (rows.join(caps.hint("merge"), "email", "left") for rows in (people, known))
    people, wide = _wider(people, users, offered)
    # What users have from wider rules is as large as the result, so it is neither sorted nor grouped: each user brings
    # the projects that exact rules settle and passes them over.
    salt = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    spread = people.withColumn("salt", F.pmod(F.xxhash64("email"), F.col("copies")).cast("int")).drop("copies")
    found = spread.join(wide.select("key", salt, "project", "rank").hint("merge"), ["key", "salt"])
    found = found.where(~F.coalesce(F.array_contains("settled", F.col("project")), F.lit(False)))
    # An exact rule without a known role counts where there is no other.
    unknown = people.join(exact.where("rank is null").hint("merge"), "email").join(wide, ["key", "project"], "left_anti")
    columns = ["email", "project.role_context", F.col("rank") if caps is None else _capped("rank")]
    ranked = known.select(columns).unionByName(found.select(columns)).unionByName(unknown.select(columns))
    if min_role is not None:
        ranked = ranked.where(F.col("rank") >= ROLES[min_role])
    return ranked.select("email", "role_context", role_name(F.col("rank")).alias("role"))


def _wider(people: DataFrame, users: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``people`` with their (key, copies), and the rules behind the exact ones as (key, copies, project, rank).

    The key is ``*@domain`` where the domain has rules, else ``*``. Rules for everyone are settled against those of a
    domain once per domain, not per user.
    """
    domain = F.concat(F.lit("*@"), F.substring_index("email", "@", -1))
    best = rules.where(F.col("email").startswith("*")).groupBy(F.col("email").alias("key"), "project")
    best = best.agg(F.max("rank").alias("rank"))
    domains = best.where("key like '*@%'")
    everyone = best.where("key = '*'").select("project", F.col("rank").alias("of_all"))
    copies = F.ceil(F.count(F.lit(1)) / _USERS_PER_COPY).cast("int").alias("copies")
    crowds = users.groupBy(domain.alias("key")).agg(copies).join(domains.select("key").distinct(), "key", "left_semi")
    known = people.withColumn("domain", domain).join(crowds, F.col("domain") == F.col("key"), "left").drop("domain")
    known = known.withColumn("key", F.coalesce("key", F.lit("*"))).withColumn("copies", F.coalesce("copies", F.lit(_SPREAD)))
    own = domains.join(crowds, "key").join(everyone, "project", "left").withColumn("rank", F.coalesce("rank", "of_all"))
    # Each domain meets one copy of the rules for everyone.
    spread = everyone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))))
    rest = crowds.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SPREAD)).cast("int")).join(spread, "salt").drop("salt")
    rest = rest.join(domains, ["key", "project"], "left_anti")
    rest = rest.unionByName(everyone.select(F.lit("*").alias("key"), F.lit(_SPREAD).alias("copies"), "project", "of_all"))
    wide = own.drop("of_all").unionByName(rest.withColumnRenamed("of_all", "rank"))
    return known, wide


def role_rules(rules: DataFrame) -> DataFrame:
    """What all users may do, as one row per pattern (address, ``*@domain`` or ``*``) and project.

    Rows ``(email, role_context, role, overrides)``: the strongest role of the pattern, and that of the next wider
    pattern with a rule in the project, which would hold without it (null if there is none). The rows grow with the
    rules, not with users times projects. `effective_role` makes from them the rows of the users who are asked for.
    """
    best = rules.groupBy("email", "role_context").agg(F.max(role_rank(F.col("role"))).alias("rank"))
    wide = F.col("email").startswith("*")
    rows = best.withColumn("domain", F.when(~wide, F.concat(F.lit("*@"), F.substring_index("email", "@", -1))))
    domains = best.where(F.col("email").startswith("*@"))
    domains = domains.select(F.col("email").alias("domain"), "role_context", F.col("rank").alias("of_domain"))
    # At most one row per project, so no join makes rows.
    everyone = best.where("email = '*'").select("role_context", F.col("rank").alias("of_all"))
    rows = rows.join(domains, ["domain", "role_context"], "left").join(everyone, "role_context", "left")
    overrides = F.when(F.col("email") != "*", F.coalesce("of_domain", "of_all"))
    return rows.select("email", "role_context", role_name(F.col("rank")).alias("role"), role_name(overrides).alias("overrides"))


def _capped(rank: str) -> Column:
    """The rank, held to the key restrictions in the same row."""
    context = F.col("project.role_context")
    own = role_rank(F.try_element_at("project_roles", context))
    project = F.coalesce(own, role_rank(F.col("default_project_role")))
    cap = F.when(context == SERVER, role_rank(F.col("server_role"))).otherwise(project)
    # least() skips nulls, so no cap means no change.
    return F.least(F.col(rank), cap).alias("rank")


def allowed_field(role: str | None, field: Field) -> Snippet | bool:
    """What a role may see of a field: everything (True), nothing (False), or a snippet up to a limit."""
    rank = ROLES[role or "NONE"]
    if rank < ROLES["METAREADER"]:
        return False
    if rank >= ROLES["READER"] or field.access == "read":
        return True
    return field.max_snippet or Snippet() if field.access == "snippet" else False


def allowed_fields(
    projects: Sequence[Mapping[str, Field]], roles: Sequence[str | None]
) -> dict[str, Snippet | None]:
    """Fields that may be read in all projects that have them; limits shrink to the smallest."""
    merged: dict[str, Snippet | bool] = {}
    for fields, role in zip(projects, roles, strict=True):
        for name, field in fields.items():
            seen, now = merged.get(name, True), allowed_field(role, field)
            if seen is False or now is False:
                merged[name] = False
            elif isinstance(seen, Snippet) and isinstance(now, Snippet):
                merged[name] = seen.smallest(now)
            else:
                merged[name] = seen if isinstance(seen, Snippet) else now
    return {n: (limit if isinstance(limit, Snippet) else None) for n, limit in merged.items() if limit is not False}


def check_request(
    requested: Mapping[str, Snippet | None], fields: Mapping[str, Field], role: str | None
) -> None:
    """Refuse a request for more than the role may see."""
    if ROLES[role or "NONE"] < ROLES["METAREADER"]:
        raise PermissionError("no access to this project")
    for name, wanted in requested.items():
        if name not in fields:
            continue
        limit = allowed_field(role, fields[name])
        if limit is False:
            raise PermissionError(f"{name!r} may not be read")
        if isinstance(limit, Snippet) and (wanted is None or not wanted.within(limit)):
            raise PermissionError(f"of {name!r} only snippets up to {limit} may be read")


def project_allowed(
    df: DataFrame, allowed: Mapping[str, Snippet | None], queries=None, filters=None, mark: bool = False
) -> DataFrame:
    """Matching documents with the allowed fields, cut to snippets where only those may be seen."""
    found = select(df, queries, filters)
    shown = {name: limit for name, limit in allowed.items() if name in df.columns}
    return found.select(ID, *present(df, shown, queries, mark))
