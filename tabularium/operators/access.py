"""Tenant stamping, row filters by access level, permission checks and identifier checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.skew import join_checked

# Permission names and the two permission maps must equal the reference's.
ACTION_PERMISSIONS = {
    "view": ["read"],
    "query": ["read"],
    "update": ["write"],
    "delete": ["delete"],
    "export": ["read"],
    "share": ["share"],
    "admin": ["admin"],
}
LEVEL_PERMISSIONS = {
    "user": ["read", "write"],
    "manager": ["read", "write", "delete", "share"],
    "admin": ["read", "write", "delete", "admin", "share", "execute"],
}
SYSTEM_COLUMNS = ["client_id", "user_id", "resource_id"]
UUID4_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
IDENTIFIER_PATTERN = "^[a-zA-Z0-9._-]+$"
IDENTIFIER_MAX = 255


def as_column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def stamp_tenant(df: DataFrame, client_id, user_id, resource_id) -> DataFrame:
    """Add the three tenancy columns (constants, or columns of the frame)."""
    return df.withColumns({
        "client_id": as_column(client_id),
        "user_id": as_column(user_id),
        "resource_id": as_column(resource_id),
    })


def drop_system_columns(df: DataFrame) -> DataFrame:
    return df.drop(*SYSTEM_COLUMNS)


def tenant_rows(df: DataFrame, client_id: str, user_id: str | None = None) -> DataFrame:
    """Rows of one client (and one of its users). Filters the source, before any query text runs."""
    df = df.where(F.col("client_id") == client_id)
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def valid_identifier(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce((F.length(c) <= IDENTIFIER_MAX) & c.rlike(IDENTIFIER_PATTERN), F.lit(False))


def may_see(user_id: str, client_id: str, level: str) -> Column:
    """Own rows for a user; every row of the same client for managers and admins."""
    askable = valid_identifier(F.lit(user_id)) & valid_identifier(F.lit(client_id))
    same_client = F.col("client_id") == client_id
    if level == "user":
        return askable & same_client & (F.col("user_id") == user_id)
    if level in ("manager", "admin"):
        return askable & same_client
    return F.lit(False)


def accessible_resources(catalog: DataFrame, user_id: str, client_id: str, level: str = "user") -> DataFrame:
    return catalog.where(may_see(user_id, client_id, level))


def _permissions(table: dict[str, list[str]], key: Column) -> Column:
    """Permission array by key; a lookup in a literal map stays inside the scan's stage."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))]
    return F.coalesce(F.create_map(*pairs)[key], F.array().cast("array<string>"))


def check_requests(requests: DataFrame, users: DataFrame, owners: DataFrame) -> DataFrame:
    """Decide access requests in bulk.

    requests(request_id, client_id, user_id, resource_id, action),
    users(client_id, user_id, access_level, is_active, resource_grants map<resource, array<permission>>),
    owners(client_id, owner_id, resource_id). A user or resource may be behind most requests, so both
    lookups are checked broadcasts with a salted join beyond the bound.
    """
    grants = F.coalesce(F.try_element_at("resource_grants", F.col("resource_id")), F.array().cast("array<string>"))
    held = F.array_union(_permissions(LEVEL_PERMISSIONS, F.col("access_level")), grants)
    required = _permissions(ACTION_PERMISSIONS, F.col("action"))
    missing = F.array_except(required, held)
    owns = F.col("resource_id").isNull() | F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False))
    reason = (
        F.when(~F.coalesce("is_active", F.lit(False)), "User permissions not found or inactive")
        .when(F.size(missing) > 0, F.concat(F.lit("Missing permissions: "), F.array_join(missing, ", ")))
        .when(~owns & ~F.array_contains(held, "admin"), "User does not own resource and lacks admin permissions")
        .otherwise("Access granted")
    )
    return (
        join_checked(join_checked(requests, users, ["client_id", "user_id"], "left"), owners, ["client_id", "resource_id"], "left")
        .withColumn("reason", reason)
        .withColumn("granted", F.col("reason") == "Access granted")
        .select(*requests.columns, "granted", "reason")
    )


def reject_reasons(catalog: DataFrame) -> DataFrame:
    """Add ``reasons``: why a catalog row is not a valid record (empty array: valid)."""
    checks = {
        "resource_id": ~F.coalesce(F.col("resource_id").rlike(UUID4_PATTERN), F.lit(False)),
        "client_id": ~valid_identifier("client_id"),
        "user_id": ~valid_identifier("user_id"),
        "file_size_bytes": F.coalesce(F.col("file_size_bytes") < 0, F.lit(True)),
        "version": F.coalesce(F.col("version") < 1, F.lit(True)),
    }
    return catalog.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))
