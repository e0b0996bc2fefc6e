"""Row visibility and scope predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_ROLES = "array<string>"


def upper_roles(roles: Column) -> Column:
    return F.transform(F.coalesce(roles, F.array().cast(_NO_ROLES)), F.upper)


def visible_to(row_roles: Column, user_roles: Column, is_admin: Column | None = None) -> Column:
    """True when the row names no role, shares one with the user, or the user is an administrator."""
    open_row = F.size(F.coalesce(row_roles, F.array().cast(_NO_ROLES))) == 0
    seen = open_row | F.arrays_overlap(upper_roles(row_roles), upper_roles(user_roles))
    return F.coalesce(seen, F.lit(False)) if is_admin is None else F.coalesce(seen | is_admin, F.lit(False))


def role_signature(roles: Column) -> Column:
    """Text that is equal for equal role sets."""
    return F.array_join(F.array_sort(F.array_distinct(upper_roles(roles))), "|")


def role_profiles(users: DataFrame) -> DataFrame:
    """Users with the signature of what they may see; administrators share one signature."""
    return users.withColumn("profile", F.when(F.col("role") == "admin", F.lit("#ADMIN")).otherwise(
        role_signature(F.col("access_roles"))))


def profile_grants(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Pairs (profile, row signature) that see each other.

    Users and rows are first reduced to their distinct role sets, then matched by an equality join on single role
    names, so the work grows with the number of role combinations, never with users × rows.
    """
    row_sets = rows.select(role_signature(F.col("access_roles")).alias("signature"),
                           upper_roles(F.col("access_roles")).alias("roles")).dropDuplicates(["signature"])
    row_tokens = row_sets.select("signature", F.explode(F.concat(
        F.array(F.lit("#ANY")), F.when(F.size("roles") == 0, F.array(F.lit("#OPEN"))).otherwise(F.col("roles")))
    ).alias("token"))
    profiles = role_profiles(users).select("profile", upper_roles(F.col("access_roles")).alias("roles"),
                                           (F.col("role") == "admin").alias("admin")).dropDuplicates(["profile"])
    user_tokens = profiles.select("profile", F.explode(F.concat(
        F.array(F.lit("#OPEN")), F.when(F.col("admin"), F.array(F.lit("#ANY"))).otherwise(F.col("roles")))
    ).alias("token"))
    return user_tokens.join(row_tokens, "token").select("profile", "signature").distinct()


def visible_rows(rows: DataFrame, users: DataFrame) -> DataFrame:
    """``rows`` once per profile that may see them, with a ``profile`` column."""
    signed = rows.withColumn("signature", role_signature(F.col("access_roles")))
    return signed.join(profile_grants(rows, users), "signature").drop("signature")


def visible_counts(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Number of visible rows per user."""
    per_sig = rows.groupBy(role_signature(F.col("access_roles")).alias("signature")).agg(F.count("*").alias("n"))
    per_profile = per_sig.join(profile_grants(rows, users), "signature").groupBy("profile").agg(F.sum("n").alias("n"))
    return (role_profiles(users).join(per_profile, "profile", "left")
            .select("user_id", F.coalesce("n", F.lit(0)).alias("visible")))


def payload_filter(wanted: dict[str, object], array_columns: tuple[str, ...] = ("access_roles",)) -> Column:
    """Conjunction of equality, any-of and array-overlap predicates given as a dict."""
    def one(name: str, value: object) -> Column:
        if not isinstance(value, (list, tuple)):
            return F.col(name) == F.lit(value)
        if name in array_columns:
            return F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in value]))
        return F.col(name).isin(*value)

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in wanted.items()], F.lit(True))


def scope_kind(doc_ids: Column, repository: Column, department: Column) -> Column:
    """The first scope a query names: documents, then repository, then department, else none."""
    return (F.when(F.size(F.coalesce(doc_ids, F.array().cast("array<bigint>"))) > 0, "DOC")
            .when(repository.isNotNull(), "REPOSITORY").when(department.isNotNull(), "DEPARTMENT").otherwise("GLOBAL"))


def in_scope(kind: Column, doc_ids: Column, repository: Column, department: Column) -> Column:
    """Hard scope predicate on a row holding both the query's scope and the chunk's attributes."""
    return (F.when(kind == "DOC", F.array_contains(doc_ids, F.col("doc_id")))
            .when(kind == "REPOSITORY", F.col("repository") == repository)
            .when(kind == "DEPARTMENT", F.col("department") == department)
            .otherwise(F.lit(True)))


def scope_sizes(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """In-scope chunk count per query, from counts per document, repository and department."""
    q = queries.withColumn("kind", scope_kind(F.col("scope_doc_ids"), F.col("scope_repository"),
                                              F.col("scope_department")))
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    doc_n = (q.filter(F.col("kind") == "DOC")
             .select("query_id", F.explode(F.array_distinct("scope_doc_ids")).alias("doc_id"))
             .join(per_doc, "doc_id").groupBy("query_id").agg(F.sum("n").alias("n_doc")))
    per_repo = chunks.groupBy(F.col("repository").alias("scope_repository")).agg(F.count("*").alias("n_repo"))
    per_dept = chunks.groupBy(F.col("department").alias("scope_department")).agg(F.count("*").alias("n_dept"))
    total = chunks.agg(F.count("*")).scalar()
    n = (F.when(F.col("kind") == "DOC", F.col("n_doc")).when(F.col("kind") == "REPOSITORY", F.col("n_repo"))
         .when(F.col("kind") == "DEPARTMENT", F.col("n_dept")).otherwise(total))
    return (q.join(doc_n, "query_id", "left").join(per_repo, "scope_repository", "left")
            .join(per_dept, "scope_department", "left")
            .select("query_id", "kind", F.coalesce(n, F.lit(0)).alias("in_scope")))


def equal_filters(wanted: dict[str, str | None]) -> Column:
    """Optional equality filters; unset ones do not restrict."""
    return payload_filter({k: v for k, v in wanted.items() if v})


def contains_ci(column: str, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(F.col(column)).contains(needle.lower())


def visible_repositories(repositories: DataFrame, users: DataFrame) -> DataFrame:
    """Repositories each user is shown: named in the user's roles, or all for EMPLOYEE and administrators."""
    roles = users.select("user_id", F.when(
        (F.col("role") == "admin") | F.array_contains(upper_roles(F.col("access_roles")), "EMPLOYEE"),
        F.array(F.lit("#ALL"))).otherwise(upper_roles(F.col("access_roles"))).alias("roles"))
    tokens = roles.select("user_id", F.explode(F.array_distinct("roles")).alias("token"))
    named = repositories.select("name", F.explode(F.array(F.upper("name"), F.lit("#ALL"))).alias("token"))
    return tokens.join(named, "token").select("user_id", "name").distinct()
