"""Insert, upsert, update and delete as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(store: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key neither the store nor an earlier row has (conflict: do nothing)."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(store.select(*key).distinct(), key, "left_anti")


def first_by_hash(rows: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """The first row of each hash; combined before the shuffle, so a hash that most rows share is no hot key."""
    rest = [c for c in rows.columns if c != hash_col]
    return rows.groupBy(hash_col).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(c) if c == hash_col else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(store: DataFrame, rows: DataFrame, key: list[str], newest: str) -> DataFrame:
    """The latest version of each key; on equal times the new rows win."""
    both = store.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    rest = [c for c in store.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(newest, "_new")).alias("_r"))
    return last.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in store.columns])


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: the fields of ``changes`` that are not null replace those of ``df``."""
    fields = [c for c in changes.columns if c != key]
    joined = df.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def delete_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def approve(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approves active documents and then their active chunks."""
    chosen = ids.select(F.col("doc_id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    docs = documents.join(chosen, documents["doc_id"] == chosen["_id"], "left").withColumn("is_approved", F.when(F.col("_hit") & F.col("is_active"), True).otherwise(F.col("is_approved"))).drop("_id")
    done = docs.where("_hit and is_active").select(F.col("doc_id").alias("_d")).withColumn("_done", F.lit(True))
    out = chunks.join(done, chunks["document_id"] == done["_d"], "left").withColumn("is_approved", F.when(F.col("_done") & F.col("is_active"), True).otherwise(F.col("is_approved"))).drop("_d", "_done")
    return docs.drop("_hit"), out


def append_distinct(column: str, value: Column) -> Column:
    return F.array_union(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(value))


def remove(column: str, value: str) -> Column:
    return F.array_remove(F.col(column), value)


def user_error(email: Column, role: Column, department: Column, taken: Column, actor_role: Column, departments: list[str]) -> Column:
    """Null for a user that may be created, else why not."""
    return (
        F.when(~F.coalesce(department.isin(departments), F.lit(False)), "unknown department").when((role != "processor") & ~F.coalesce(actor_role == "super_admin", F.lit(False)), "role not allowed")
        .when(~F.contains(F.trim(F.coalesce(email, F.lit(""))), F.lit("@")), "invalid address").when(taken, "address taken")
    )


def create_users(users: DataFrame, requests: DataFrame, departments: list[str]) -> DataFrame:
    """``requests`` (``email``, ``role``, ``department``, ``actor_role``) with the address in lower case and ``error``."""
    tidy = requests.withColumn("email", F.lower(F.trim("email")))
    there = users.select(F.lower("email").alias("email")).distinct().withColumn("_taken", F.lit(True))
    joined = tidy.join(there, "email", "left")
    return joined.withColumn("error", user_error(F.col("email"), F.col("role"), F.col("department"), F.coalesce("_taken", F.lit(False)), F.col("actor_role"), departments)).drop("_taken")
