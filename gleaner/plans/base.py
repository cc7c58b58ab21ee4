"""Registration of queries with their SQL, and the engine's tables as views of the test tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import search, segments
from gleaner.storage import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables with texts, and the column by which they are dealt out.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. A table of texts that is stored in fewer parts than the session has cores is dealt out; large tables have more parts and stay where they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, TEXTS[name])
    return df


def r6(x: Column) -> Column:
    """Six digits, half up by floor, the same in both engines."""
    return X.rounded(x, 6)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source records."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_id"),
        F.left("text", F.lit(60)).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.floor(F.col("doc_id") / 40).cast("string")).alias("canonical_url"),
        F.col("source").alias("category"),
        F.col("lang").alias("language"),
        F.lit("2026-01-01T00:00:00Z").alias("retrieved_at"),
        X.checksum(F.col("text")).alias("checksum"),
        F.lit("active").alias("source_status"),
        F.col("text").alias("content"),
    )


#: The same for DuckDB; many records share a URL.
RECORDS = """records AS (SELECT 'doc_' || doc_id AS source_id, doc_id, left(text, 60) AS title, 'https://' || source || '.example/' || (doc_id // 40) AS canonical_url,
  source AS category, lang AS language, 'sha256:' || sha256(text) AS checksum, text AS content FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


TOKEN_SQL = "[a-zåäö0-9][a-zåäö0-9_-]+"


def terms_sql(text: str, stop_words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in stop_words)
    return f"list_filter(list_transform(regexp_extract_all({text}, '(?i){TOKEN_SQL}'), lambda t: lower(t)), lambda t: NOT list_contains([{listed}], t))"


def r6_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}.0"


def related_sql(token: str, term: str) -> str:
    if len(term) < 5:
        return f"{token} = '{term}'"
    return f"({token} = '{term}' OR (length({token}) >= 5 AND (contains({token}, '{term}') OR contains('{term}', {token}))))"


def sentences_sql(text: str) -> str:
    marked = rf"regexp_replace(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def words_sql(text: str) -> str:
    """Words between white space."""
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


WORD_SQL = r"[\p{L}\p{N}_]+"


_INDEXES: dict[tuple[str, str], tuple[str, str]] = {}


def files_digest(spark: SparkSession, path: str) -> str:
    """A digest of a table's files: names, lengths and times of change. No row is read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen, todo = [], [place]
    while todo:
        for f in files.listStatus(todo.pop()):
            if f.isDirectory():
                todo.append(f.getPath())
            else:
                seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def stored_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    """The index of documents as records, each one chunk: built by the first query of a session that asks for it, read by the others as long as the table's files are the same, and brought up to date where they changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    now = files_digest(spark, f"{sf_dir}/documents.parquet")
    folder, then = _INDEXES.get(key) or (work_folder(spark), None)
    if then != now:
        segments.update(records(spark, sf_dir), folder, lambda r: r.withColumn("chunk_id", F.col("source_id")))
        _INDEXES[key] = (folder, now)
    return segments.Index.read(spark, folder)


def asked(spark: SparkSession, questions: dict[int, str], language: str = "en", category: str | None = None) -> DataFrame:
    return spark.createDataFrame([(k, language, category, q) for k, q in questions.items()], search.QUESTIONS)
