"""Source records: projection, validation, gates and registry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as X

REQUIRED = ("source_id", "title", "canonical_url", "category", "language", "retrieved_at", "checksum", "source_status", "content")


def reason_invalid(languages: tuple[str, ...] = ("en", "sv")) -> Column:
    """Why a record is invalid, the first of the checks in order; null if it is valid."""
    content = X.trim_space(F.col("content"))
    blank = F.lit(False)
    for c in REQUIRED:
        blank = blank | F.coalesce(X.trim_space(F.col(c)) == "", F.lit(False))
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    url = F.col("canonical_url")
    bad_url = ~url.rlike(r"^https?://[^/?#@\s\\]+([/?#][^\s\\]*)?$") | F.coalesce(url.rlike(r"(?i)^https?://([^/?#:]*\.)?(localhost|local|internal)([:/?#]|$)"), F.lit(False)) | url.rlike(r"/\.\.?(/|$|\?|#)")
    return (
        F.when(missing, "missing_metadata")
        .when(blank, "blank_metadata")
        .when(~F.col("source_id").rlike(r"^[A-Za-z0-9_-]+$"), "invalid_source_id")
        .when(bad_url, "invalid_url")
        .when(~F.col("language").isin(*languages), "unsupported_language")
        .when(~F.col("source_status").isin("active", "archived"), "invalid_status")
        .when(X.matches(content, config.INJECTION), "instruction_like_content")
        .when(F.col("checksum") != X.checksum(content), "checksum_mismatch")
    )


def validated(records: DataFrame, languages: tuple[str, ...] = ("en", "sv")) -> DataFrame:
    """All columns with reason added; it is null for valid records."""
    return records.withColumn("reason", reason_invalid(languages))


def with_derived(records: DataFrame) -> DataFrame:
    """id, source_url, retrieval_date and version added."""
    version = F.coalesce(F.nullif(F.col("document_version"), F.lit("")), F.lit("unversioned")) if "document_version" in records.columns else F.lit("unversioned")
    return records.withColumns({"id": F.col("source_id"), "source_url": F.col("canonical_url"), "retrieval_date": F.left("retrieved_at", F.lit(10)), "version": version})


def active(records: DataFrame) -> DataFrame:
    return records.where(F.col("source_status") == "active")


def sufficient(content: Column) -> Column:
    """Fifty characters and eight words at least, 100,000 characters at most."""
    return (F.length(content) >= 50) & (X.word_count(content) >= 8) & (F.length(content) <= 100_000)


def matching_rows(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows where the columns, joined by spaces, contain the query in any case."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(query.lower()))


def registry_mismatches(evidence: DataFrame, registry: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Evidence that the registry doesn't back: no such source, another field value, or content that isn't a part of its content."""
    r = registry.select("source_id", *(F.col(c).alias(f"__{c}") for c in (*fields, "content")))
    joined = evidence.join(r, "source_id", "left")
    differs = F.col("__content").isNull() | ~F.col("__content").contains(F.col("content"))
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return joined.where(differs).select(*evidence.columns)


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def category_listing(records: DataFrame, category: str, language: str) -> DataFrame:
    return records.where((F.col("category") == category) & (F.col("language") == language))


def allowed_upload(name: Column, media_type: Column, size: Column) -> Column:
    """Why an upload is refused, or null: extension, media type and size must fit together."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    mib = 1024 * 1024
    kinds = {
        ".txt": (("text/plain",), mib), ".md": (("text/markdown", "text/plain"), mib), ".csv": (("text/csv", "application/vnd.ms-excel", "text/plain"), mib),
        ".xlsx": (("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), 5 * mib), ".docx": (("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), 5 * mib), ".pdf": (("application/pdf",), 5 * mib),
    }
    out = F.when(~extension.isin(*kinds), "unsupported_extension")
    for e, (media, most) in kinds.items():
        out = out.when((extension == e) & ~media_type.isin(*media), "media_type_mismatch").when((extension == e) & (size > most), "too_large")
    return out.when(size <= 0, "empty")


#: The columns of a record that the public may see, fixed values.
PUBLIC = ("source_id", "title", "canonical_url", "category", "language", "source_status", "retrieved_at", "checksum", "document_version", "content")


def public_record(records: DataFrame) -> DataFrame:
    """The public columns, those that the records have."""
    return records.select(*(c for c in PUBLIC if c in records.columns))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file: a list of records, or an object whose `records` is one. Extra fields stay.

    A snapshot is one JSON value, so Spark reads a file in one task; several files of a folder are read side by side.
    """
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.explode("records").alias("r")).select("r.*") if raw.columns and "records" in raw.columns else raw


def existing(keys: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """keys with exists: whether the table has a row of the same columns."""
    there = table.select(*columns).distinct().withColumn("__in", F.lit(True))
    return keys.join(there, columns, "left").withColumn("exists", F.col("__in").isNotNull()).drop("__in")
