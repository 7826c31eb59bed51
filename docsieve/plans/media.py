"""Queries on the media register and on role rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docsieve.functions.ids import mime_from_extension, path_extension, path_file, path_folder
from docsieve.operators.access import effective_role, role_rules
from docsieve.operators.objects import (
    delete_objects,
    list_objects,
    object_total,
    quota_running,
    reconcile_objects,
    register_objects,
)
from docsieve.plans.corpora import table
from docsieve.plans.registry import query

NOW = dt.datetime(2024, 1, 3, 12, 0, 0)
QUOTA = 300_000


def files(spark, sf_dir):
    """Pages as media files: the language is the project, the host is the folder."""
    url = F.col("url")
    ending = (
        F.when(url.endswith(".html"), F.lit(".png"))
        .when(url.endswith("#top"), F.lit(".JPG"))
        .when(url.contains("?"), F.lit(".mp4"))
        .otherwise(F.lit(".gif"))
    )
    host = F.regexp_extract(url, "^https?://([^/]*)/", 1)
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract(url, "^https?://[^/]*/([^/]*)/", 1).alias("index"),
        F.lit("image").alias("field"),
        F.concat(host, F.lit("/"), F.col("page_id").cast("string"), ending).alias("filepath"),
        F.length("html").cast("bigint").alias("size"),
        F.col("page_id").alias("position"),
        "url",
    )


FILES = """(SELECT regexp_extract(url, '^https?://[^/]*/([^/]*)/', 1) AS index, 'image' AS field,
      regexp_extract(url, '^https?://([^/]*)/', 1) || '/' || CAST(page_id AS VARCHAR) || CASE
        WHEN ends_with(url, '.html') THEN '.png' WHEN ends_with(url, '#top') THEN '.JPG'
        WHEN contains(url, '?') THEN '.mp4' ELSE '.gif' END AS filepath,
      CAST(length(html) AS BIGINT) AS size, page_id AS position, url FROM pages)"""
_MIME = """CASE lower(regexp_extract(filepath, '[.]([^./]*)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg'
    WHEN 'mp4' THEN 'video/mp4' WHEN 'gif' THEN 'image/gif' END"""


def register(spark, sf_dir):
    """The register as it stands: every file except the videos, entered one minute after the other."""
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("position").cast("int"))
    return (
        files(spark, sf_dir)
        .where("filepath not like '%.mp4'")
        .select(
            "index",
            "field",
            "filepath",
            path_folder(F.col("filepath")).alias("path"),
            "size",
            mime_from_extension(path_extension(F.col("filepath"))).alias("content_type"),
            (F.lit("2024-01-02 09:00:00").cast("timestamp_ntz") + minutes).alias("registered"),
            F.lit(None).cast("timestamp_ntz").alias("last_synced"),
        )
    )


REGISTER = f"""(SELECT index, field, filepath, regexp_extract(filepath, '^(.*)/', 1) AS path, size, {_MIME} AS content_type,
      TIMESTAMP '2024-01-02 09:00:00' + to_minutes(position) AS registered, url FROM {FILES}
    WHERE filepath NOT LIKE '%.mp4')"""


def requests(spark, sf_dir):
    """Files sent in: pages on secure hosts have grown, the others are as they were."""
    grown = F.when(F.col("url").startswith("https"), F.col("size") + 500).otherwise(F.col("size"))
    return files(spark, sf_dir).withColumn("size", grown).drop("url")


REQUESTS = f"""(SELECT index, field, filepath, position,
    size + CASE WHEN starts_with(url, 'https') THEN 500 ELSE 0 END AS size FROM {FILES})"""

_RUNNING = f"""(SELECT *, sum(added) OVER (PARTITION BY index ORDER BY position) + coalesce(stored, 0) AS running FROM (
      SELECT q.*, r.size AS old_size, q.size - coalesce(r.size, 0) AS added,
        (SELECT sum(size) FROM {REGISTER} t WHERE t.index = q.index) AS stored
      FROM {REQUESTS} q LEFT JOIN {REGISTER} r
        ON q.index = r.index AND q.field = r.field AND q.filepath = r.filepath
      WHERE r.size IS NULL OR r.size <> q.size))"""


@query("object_total", f"SELECT index, CAST(sum(size) AS BIGINT) AS total FROM {REGISTER} GROUP BY index")
def _(spark, sf_dir):
    return object_total(register(spark, sf_dir))


@query(
    "quota_running",
    f"""SELECT index, filepath, added, CAST(running AS BIGINT) AS running_total,
          max(running) OVER (PARTITION BY index ORDER BY position) <= {QUOTA} AS within_quota FROM {_RUNNING}""",
)
def _(spark, sf_dir):
    totals = quota_running(requests(spark, sf_dir), register(spark, sf_dir), QUOTA)
    return totals.select("index", "filepath", "added", "running_total", "within_quota")


_IMAGE_REQUESTS = f"(SELECT * FROM {_RUNNING} WHERE filepath NOT LIKE '%.mp4')"


@query(
    "register_objects",
    f"""WITH wanted AS (SELECT *, {_MIME} AS content_type FROM {_RUNNING}),
        bad AS (SELECT DISTINCT index FROM wanted WHERE content_type NOT LIKE 'image%' OR running > 100000000),
        taken AS (SELECT * FROM wanted WHERE index NOT IN (SELECT index FROM bad))
        SELECT index, filepath, regexp_extract(filepath, '^(.*)/', 1) AS path, size, content_type,
          TIMESTAMP '2024-01-03 12:00:00' AS registered FROM taken
        UNION ALL SELECT r.index, r.filepath, r.path, r.size, r.content_type, r.registered FROM {REGISTER} r
          LEFT JOIN taken t ON r.index = t.index AND r.filepath = t.filepath WHERE t.index IS NULL""",
)
def _(spark, sf_dir):
    # Languages that send in a video get nothing; the others get their new sizes.
    added = register_objects(register(spark, sf_dir), requests(spark, sf_dir), "image", 100_000_000, NOW)
    return added.register.select("index", "filepath", "path", "size", "content_type", "registered")


@query(
    "register_refused",
    f"""SELECT index, field, filepath, CASE WHEN filepath LIKE '%.mp4' THEN 'type does not fit the field'
          ELSE 'over quota' END AS reason
        FROM (SELECT *, max(running) OVER (PARTITION BY index ORDER BY position) AS highest FROM {_RUNNING})
        WHERE filepath LIKE '%.mp4' OR highest > {QUOTA}""",
)
def _(spark, sf_dir):
    return register_objects(register(spark, sf_dir), requests(spark, sf_dir), "image", QUOTA, NOW).refused


@query(
    "list_objects",
    f"""SELECT filepath, size FROM {REGISTER} WHERE index = 'en' AND path = 'blog.tionsh.example.net'
        AND contains(filepath, 'g')""",
)
def _(spark, sf_dir):
    found = list_objects(register(spark, sf_dir), "en", "/blog.tionsh.example.net/", contains="g")
    return found.select("filepath", "size")


@query("list_objects_recursive", f"SELECT filepath, path, size FROM {REGISTER} WHERE index = 'en'")
def _(spark, sf_dir):
    return list_objects(register(spark, sf_dir), "en", recursive=True).select("filepath", "path", "size")


@query("delete_objects", f"SELECT index, filepath FROM {REGISTER} WHERE index <> 'fr'")
def _(spark, sf_dir):
    return delete_objects(register(spark, sf_dir), "fr", "image").select("index", "filepath")


@query(
    "reconcile_objects",
    f"""WITH store AS (SELECT index, filepath, size + 1 AS size FROM {FILES} WHERE NOT ends_with(url, '#top'))
        SELECT coalesce(r.index, s.index) AS index, coalesce(r.filepath, s.filepath) AS filepath,
          coalesce(r.path, regexp_extract(s.filepath, '^(.*)/', 1)) AS path, coalesce(s.size, r.size) AS size,
          coalesce(r.content_type, '') AS content_type, s.index IS NOT NULL AS synced
        FROM {REGISTER} r FULL JOIN store s ON r.index = s.index AND r.filepath = s.filepath
        WHERE s.index IS NOT NULL OR r.registered > TIMESTAMP '2024-01-02 11:00:00'""",
)
def _(spark, sf_dir):
    # The store has lost the pages that end in #top, gained the videos, and holds one byte more of each file.
    store = files(spark, sf_dir).where("url not like '%#top'").withColumn("size", F.col("size") + 1)
    synced = reconcile_objects(register(spark, sf_dir), store, NOW)
    return synced.select(
        "index",
        "filepath",
        "path",
        "size",
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.col("last_synced").isNotNull().alias("synced"),
    )


@query(
    "path_split",
    f"""SELECT filepath, regexp_extract(filepath, '^(.*)/', 1) AS folder, regexp_extract(filepath, '[^/]*$') AS file,
          lower(regexp_extract(filepath, '[.]([^./]*)$', 1)) AS extension FROM {FILES}""",
)
def _(spark, sf_dir):
    path = F.col("filepath")
    return files(spark, sf_dir).select(
        "filepath",
        path_folder(path).alias("folder"),
        path_file(path).alias("file"),
        path_extension(path).alias("extension"),
    )


@query("mime_from_ext", f"SELECT filepath, {_MIME} AS content_type FROM {FILES}")
def _(spark, sf_dir):
    kind = mime_from_extension(path_extension(F.col("filepath")))
    return files(spark, sf_dir).select("filepath", kind.alias("content_type"))


def users(spark, sf_dir):
    """Customers as users; their market segment is their domain."""
    name = F.lower(F.replace(F.col("c_name"), F.lit("#")))
    email = F.concat(name, F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    return table(spark, sf_dir, "customer").withColumn("email", email)


USERS = """(SELECT *, lower(replace(c_name, '#', '')) || '@' || lower(c_mktsegment) || '.example' AS email FROM customer)"""


def rules(spark, sf_dir):
    """Nations as projects. Every user has a rule in their own one, domains in those they are many in, guests in
    those of one region."""
    people, nation = users(spark, sf_dir), table(spark, sf_dir, "nation")
    balance = F.col("c_acctbal")
    role = (
        F.when(balance < 0, F.lit("NONE"))
        .when(balance < 3000, F.lit("OBSERVER"))
        .when(balance < 7000, F.lit("WRITER"))
        .otherwise(F.lit("ADMIN"))
    )
    home = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("role_context")
    own = people.select("email", home, role.alias("role"))
    domain = F.concat(F.lit("*@"), F.substring_index("email", "@", -1))
    many = people.groupBy(domain.alias("email"), home).agg(F.count(F.lit(1)).alias("n"))
    shared = many.select("email", "role_context", F.when(F.col("n") > 12, "READER").otherwise("METAREADER").alias("role"))
    guests = nation.where("n_regionkey = 1").select(
        F.lit("*").alias("email"), F.col("n_name").alias("role_context"), F.lit("OBSERVER").alias("role")
    )
    return own.unionByName(shared).unionByName(guests)


RULES = f"""(SELECT email, 'NATION_' || c_nationkey AS role_context, CASE WHEN c_acctbal < 0 THEN 'NONE'
      WHEN c_acctbal < 3000 THEN 'OBSERVER' WHEN c_acctbal < 7000 THEN 'WRITER' ELSE 'ADMIN' END AS role FROM {USERS}
    UNION ALL SELECT '*@' || split_part(email, '@', 2), 'NATION_' || c_nationkey,
      CASE WHEN count(*) > 12 THEN 'READER' ELSE 'METAREADER' END FROM {USERS} GROUP BY ALL
    UNION ALL SELECT '*', n_name, 'OBSERVER' FROM nation WHERE n_regionkey = 1)"""
_RANK = "list_position(['NONE', 'OBSERVER', 'METAREADER', 'READER', 'WRITER', 'ADMIN'], {})"
_MATCHED = f"""(SELECT email, role_context, arg_max(role, strength) AS role FROM (
      SELECT u.email, r.role_context, r.role, 3 AS strength FROM {USERS} u JOIN {RULES} r ON r.email = u.email
      UNION ALL SELECT u.email, r.role_context, r.role, 2 FROM {USERS} u JOIN {RULES} r
        ON r.email = '*@' || split_part(u.email, '@', 2)
      UNION ALL SELECT u.email, r.role_context, r.role, 1 FROM {USERS} u JOIN {RULES} r ON r.email = '*'
    ) GROUP BY email, role_context)"""


@query("effective_role", f"SELECT email, role_context, role FROM {_MATCHED}")
def _(spark, sf_dir):
    return effective_role(users(spark, sf_dir), rules(spark, sf_dir))


@query(
    "effective_role_capped",
    f"""SELECT email, role_context, role FROM (
          SELECT m.email, m.role_context, CASE WHEN u.c_mktsegment = 'MACHINERY' AND {_RANK.format("m.role")} >
              CASE WHEN m.role_context = 'NATION_1' THEN 2 ELSE 4 END
            THEN CASE WHEN m.role_context = 'NATION_1' THEN 'OBSERVER' ELSE 'READER' END ELSE m.role END AS role
          FROM {_MATCHED} m JOIN {USERS} u ON m.email = u.email) WHERE {_RANK.format("role")} >= 3""",
)
def _(spark, sf_dir):
    # Keys of one segment are held to READER, and in one project to OBSERVER.
    caps = (
        users(spark, sf_dir)
        .where("c_mktsegment = 'MACHINERY'")
        .select(
            "email",
            F.lit(None).cast("string").alias("server_role"),
            F.lit("READER").alias("default_project_role"),
            F.create_map(F.lit("NATION_1"), F.lit("OBSERVER")).alias("project_roles"),
        )
    )
    return effective_role(users(spark, sf_dir), rules(spark, sf_dir), caps, "METAREADER")


@query(
    "role_rules",
    f"""SELECT r.email, r.role_context, r.role,
          CASE WHEN r.email = '*' THEN NULL ELSE coalesce(d.role, a.role) END AS overrides
        FROM {RULES} r LEFT JOIN {RULES} d ON r.email NOT LIKE '*%' AND d.role_context = r.role_context
          AND d.email = '*@' || split_part(r.email, '@', 2)
        LEFT JOIN {RULES} a ON a.role_context = r.role_context AND a.email = '*'""",
)
def _(spark, sf_dir):
    # Each rule comes twice, the second time as NONE, which never is the stronger one.
    again = rules(spark, sf_dir).withColumn("role", F.lit("NONE"))
    return role_rules(rules(spark, sf_dir).unionByName(again))


@query(
    "effective_role_of_projects",
    f"SELECT email, role_context, role FROM {_MATCHED} WHERE role_context IN ('NATION_1', 'BRAZIL')",
)
def _(spark, sf_dir):
    return effective_role(users(spark, sf_dir), role_rules(rules(spark, sf_dir)), contexts=["NATION_1", "BRAZIL"])
