"""What is recorded with an uploaded file, and what is inferred from its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Values a document may be filed under (fixed values); another vocabulary is a parameter.
DOC_TYPES = ["glossary", "policy", "procedure", "underwriting", "eligibility", "compliance", "product_guide", "system_guide", "sop"]
DEPARTMENTS = ["general", "underwriting", "compliance", "origination", "servicing"]
AUTO, DEFAULT_DEPARTMENT, SIDECAR_SUFFIX = "auto", "general", ".meta.json"
_FIELDS = ("doc_type", "department", "client_id")


def valid(value: Column | str, vocabulary: list[str], also: str | None = None) -> Column:
    return F.coalesce(T._c(value).isin([*vocabulary, *([also] if also else [])]), F.lit(False))


def sidecar_path(path: Column | str) -> Column:
    return F.concat(T._c(path), F.lit(SIDECAR_SUFFIX))


def write_sidecar(*fields: Column | str) -> Column:
    """JSON of (doc_type, department, client_id, uploaded_by) without empty values; null if none is left."""
    *texts, user = (T._c(f) for f in fields)
    held = [F.when(t != "", t).alias(n) for t, n in zip(texts, _FIELDS)] + [F.when(user != 0, user).alias("uploaded_by")]
    made = F.to_json(F.struct(*held))
    return F.when(made != "{}", made)


def read_sidecar(json: Column | str) -> Column:
    """struct<doc_type, department, client_id, uploaded_by>: texts that are texts and not empty, and a
    positive whole number (also one written as text); anything else is null, and nothing fails."""
    raw = F.from_json(T._c(json), "map<string,string>", {"mode": "PERMISSIVE"})
    kind = lambda k: F.get_json_object(T._c(json), f"$.{k}")
    quoted = lambda k: T._c(json).rlike(rf'"{k}"\s*:\s*"')
    number = F.when(raw["uploaded_by"].rlike("^[0-9]{1,18}$"), raw["uploaded_by"].cast("bigint"))
    texts = [F.when(quoted(k) & (kind(k) != ""), kind(k)).alias(k) for k in _FIELDS]
    return F.struct(*texts, F.when(number > 0, number).alias("uploaded_by"))


def resolve(df: DataFrame, path: str, text: str, sidecar: str, doc_types: list[str] = DOC_TYPES, departments: list[str] = DEPARTMENTS) -> DataFrame:
    """``df`` with ``title``, ``doc_type``, ``department``, ``client_id`` and ``uploaded_by``.

    ``sidecar`` is a column of :func:`read_sidecar`'s kind.  A valid choice comes before inference, an
    invalid one counts as none; the department and the client are never inferred.
    """
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", "")
    chosen = F.col(f"{sidecar}.doc_type")
    return df.select(
        "*", F.coalesce(T.guess_title(text), stem).alias("title"),
        F.when(valid(chosen, doc_types), chosen).otherwise(T.guess_doc_type(text)).alias("doc_type"),
        F.when(valid(f"{sidecar}.department", departments), F.col(f"{sidecar}.department")).otherwise(DEFAULT_DEPARTMENT).alias("department"),
        F.col(f"{sidecar}.client_id").alias("client_id"), F.col(f"{sidecar}.uploaded_by").alias("uploaded_by"),
    )


def readable_size(size: Column | str) -> Column:
    """Bytes as B, KB or MB with at most one decimal."""
    n = T._c(size)
    short = lambda unit, name: F.concat(F.regexp_replace(F.format_string("%.1f", n / unit), r"\.0$", ""), F.lit(name))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, short(1024.0, " KB")).otherwise(short(1024.0 * 1024, " MB"))
