"""Scoping, filters, listings and checks on library rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schemas import DOCUMENT_STATUSES

# Filter keys that name a column differently; the sentinel for "no page".
FILTER_COLUMNS = {"document_ids": "document_id"}
NO_PAGE = -1


def scope_to_user(df: DataFrame, user_id: object) -> DataFrame:
    """Rows of one owner. No owner is an error, never "everybody"."""
    if user_id is None:
        raise ValueError("user_id is required")
    return df.filter(F.col("user_id") == F.lit(user_id))


def apply_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """AND of all clauses. None skips a clause; a collection means "one of"; an empty one matches nothing.

    A one-column DataFrame as value means "one of its rows", for lists too long for a predicate.
    """
    for name, value in filters.items():
        column = FILTER_COLUMNS.get(name, name)
        if column not in df.columns:
            raise KeyError(f"unknown filter key {name!r}")
        if value is None:
            continue
        if isinstance(value, DataFrame):
            ids = value.select(F.col(value.columns[0]).alias(column)).distinct()
            df = df.join(ids, column, "left_semi").select(*df.columns)
        elif isinstance(value, (list, tuple, set, frozenset)):
            df = df.filter(F.col(column).isin(list(value)) if value else F.lit(False))
        else:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def normalize_hits(df: DataFrame) -> DataFrame:
    """Blank metadata strings and the page sentinel become null."""
    changes: dict[str, Column] = {
        c: F.nullif(F.col(c), F.lit(""))
        for c in ("section", "company", "fiscal_period", "report_type")
        if c in df.columns
    }
    changes |= {
        c: F.nullif(F.col(c), F.lit(NO_PAGE)).cast("int") for c in ("page_start", "page_end") if c in df.columns
    }
    return df.withColumns(changes)


def email_key(email: Column | str) -> Column:
    return F.lower(F.trim(F.col(email) if isinstance(email, str) else email))


def duplicate_accounts(users: DataFrame) -> DataFrame:
    """E-mail keys that more than one account holds, with the earliest account."""
    first = F.min(F.struct("created_at", "id"))
    return (
        users.groupBy(email_key("email").alias("email_key"))
        .agg(F.count(F.lit(1)).alias("accounts"), first.alias("first"))
        .filter("accounts > 1")
        .select("email_key", "accounts", F.col("first.id").alias("first_id"), F.col("first.created_at").alias("first_created_at"))
    )


def list_library(
    documents: DataFrame,
    user_id: object,
    page_size: int,
    after: tuple[object, object] | None = None,
    status: str | None = None,
) -> DataFrame:
    """One page of a user's documents, newest first, then by id.

    ``after`` is the (created_at, id) of the last row already shown, so every page is a top-k scan.
    """
    df = apply_filters(scope_to_user(documents, user_id), {"status": status} if status else {})
    if after is not None:
        at, last_id = (F.lit(v) for v in after)
        df = df.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > last_id)))
    return df.orderBy(F.col("created_at").desc(), "id").limit(page_size)


def library_overview(
    documents: DataFrame,
    analyses: DataFrame,
    analysis_types: tuple[str, ...] = ("metrics", "insights", "comparison"),
) -> DataFrame:
    """Per user: documents by status, newest document, stored analyses by type.

    The type list is the fixed vocabulary, so both pivots are plain conditional counts. An analysis
    counts for the owner of the documents it refers to, once.
    """
    docs = documents.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(F.col("status") == s).alias(s) for s in DOCUMENT_STATUSES],
        F.max("created_at").alias("newest_at"),
    )
    owners = documents.select(F.col("id").alias("document_id"), F.col("user_id").alias("owner"))
    refs = analyses.select("id", "type", F.explode("document_ids").alias("document_id"))
    done = (
        refs.join(owners, "document_id")
        .select("owner", "id", "type")
        .distinct()
        .groupBy(F.col("owner").alias("user_id"))
        .agg(*[F.count_if(F.col("type") == t).alias(f"{t}_analyses") for t in analysis_types])
    )
    return docs.join(done, "user_id", "left").fillna(0, [f"{t}_analyses" for t in analysis_types])


def validate_metrics(metrics: DataFrame, documents: DataFrame) -> DataFrame:
    """Metric rows that break the page rule, with a reason.

    Null is a legal value; a number must name a page within its document. ``documents`` is
    (id, page_count).
    """
    pages = documents.select(F.col("id").alias("document_id"), "page_count", F.lit(True).alias("_known"))
    page = F.col("source_page")
    reason = (
        F.when(F.col("_known").isNull(), F.lit("unknown_document"))
        .when(page.isNull(), F.lit("missing_page"))
        .when((page < 1) | (page > F.col("page_count")), F.lit("page_out_of_range"))
    )
    return (
        metrics.filter("value is not null")
        .join(pages, "document_id", "left")
        .withColumn("reason", reason)
        .filter("reason is not null")
        .select(*metrics.columns, "reason")
    )


def _missing_required(value: Column, kind: T.DataType) -> Column:
    """True when a field or array element declared NOT NULL is null, at any depth of a value that is there."""
    if isinstance(kind, T.StructType):
        missing = F.lit(False)
        for f in kind.fields:
            inner = value[f.name]
            if not f.nullable:
                missing = missing | inner.isNull()
            missing = missing | (inner.isNotNull() & _missing_required(inner, f.dataType))
        return missing
    if isinstance(kind, T.ArrayType):

        def lacks(x: Column) -> Column:
            inside = x.isNotNull() & _missing_required(x, kind.elementType)
            return inside if kind.containsNull else x.isNull() | inside

        return F.coalesce(F.exists(value, lacks), F.lit(False))
    return F.lit(False)


def parse_structured(df: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """Parse model output into ``parsed``; ``outcome`` is ``ok`` or ``invalid_response``.

    Broken JSON, a value of the wrong type and a null in a required field are all invalid, and
    then ``parsed`` is null.
    """
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    loose = loose.add("_broken", T.StringType())
    raw = F.from_json(json_col, loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = df.withColumn("_raw", raw)
    valid = (
        F.col(json_col).isNotNull()
        & F.col("_raw").isNotNull()
        & F.col("_raw._broken").isNull()
        & ~_missing_required(F.col("_raw"), schema)
    )
    fields = F.struct(*[F.col(f"_raw.{f.name}").alias(f.name) for f in schema.fields])
    return (
        parsed.withColumn("parsed", F.when(valid, fields))
        .withColumn("outcome", F.when(valid, F.lit("ok")).otherwise(F.lit("invalid_response")))
        .drop("_raw")
    )
