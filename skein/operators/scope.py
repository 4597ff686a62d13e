"""Row-level access scopes and other filters, built as pushable Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN_ROLES = ("admin", "super_admin")
STAFF_ROLES = ("processor", "underwriter", "manager", "compliance")


def visible(role: str | None, client_id: str | None = None, assigned: list[str] | None = None, column: str = "client_id") -> Column:
    """Which rows a caller may see: everything for administrators, the own client's for clients,
    unowned and assigned clients' for staff, nothing for anybody else."""
    if role in ADMIN_ROLES:
        return F.lit(True)
    if role == "client":
        return F.col(column) == client_id if client_id else F.lit(False)
    if role in STAFF_ROLES:
        free = F.col(column).isNull()
        return free | F.col(column).isin(assigned) if assigned else free
    return F.lit(False)


def visible_to_users(rows: DataFrame, users: DataFrame, column: str = "client_id") -> DataFrame:
    """The batch form: (user id, row) pairs as equi joins, never a cross join.

    Administrators are left out (they see the table itself); ``users`` has ``user_id``, ``role``,
    ``client_id`` and ``assigned_clients``.
    """
    own = users.where(F.col("role") == "client").select("user_id", F.col("client_id").alias("_scope"))
    staff = users.where(F.col("role").isin(*STAFF_ROLES))
    assigned = staff.select("user_id", F.explode("assigned_clients").alias("_scope"))
    scopes = own.unionByName(assigned).where("_scope is not null").distinct()
    return rows.join(scopes, rows[column] == scopes["_scope"]).drop("_scope")


def approved(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that are active, approved and embedded, of documents that are active and approved."""
    live = documents.where("is_active and is_approved").select(F.col("doc_id").alias("document_id"))
    return chunks.where("is_active and is_approved and embedding is not null").join(live, "document_id", "left_semi")


def version_filter(active_only: bool = True, approved_only: bool = True, least_version: int = 1) -> Column:
    condition = F.col("version") >= least_version
    if active_only:
        condition = condition & F.col("is_active")
    return condition & F.col("is_approved") if approved_only else condition


def audit_filter(user_id: int | None = None, since: str | None = None, until: str | None = None, least_confidence: float | None = None, outcome: str | None = None) -> Column:
    condition = F.lit(True)
    if user_id is not None:
        condition = condition & (F.col("user_id") == user_id)
    if since:
        condition = condition & (F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        condition = condition & (F.col("created_at") < F.lit(until).cast("timestamp"))
    if least_confidence is not None:
        condition = condition & (F.col("confidence") >= least_confidence)
    return condition & (F.col("outcome") == outcome) if outcome else condition


def valid_client_id(column: str) -> Column:
    return (F.length(column) <= 100) & (F.length(F.trim(column)) > 0) & ~F.col(column).rlike(r"[\x00-\x1f\x7f]")


def upload_error(filename: str, size: str, suffixes: list[str], limit: int) -> Column:
    """Null for an upload that may pass, else why not."""
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
    return (
        F.when(F.coalesce(F.trim(filename), F.lit("")) == "", "empty name").when(F.col(filename).rlike(r"[/\\]|\.\."), "path in name")
        .when(~suffix.isin(suffixes), "suffix not allowed").when(F.col(size) > limit, "too large").when(F.col(size) <= 0, "empty file")
    )


LADDER = ("client", "processor", "admin", "super_admin")


def at_least(role: str, least: str) -> Column:
    """Whether a role stands at ``least`` or higher on the ladder; clients and unknown roles never do."""
    ladder = F.array(*[F.lit(r) for r in LADDER])
    return F.coalesce((F.array_position(ladder, F.col(role)) >= LADDER.index(least) + 1) & (F.col(role) != LADDER[0]), F.lit(False))
