"""A training corpus from raw documents: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontam, linedup, nearcopies, quality
from gleaner.llm.common import remove, shared_folder, table
from gleaner.llm.queries import split_pattern, tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another column as text and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 0 for go; without labels, all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs.select(*COLUMNS)
    return quality.score(docs, model, keep=tuple(COLUMNS[1:])).where("score >= 0.7").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go from the texts; documents of which nothing is left go too."""
    deduped = linedup.dedup_lines(docs.select(*COLUMNS))
    return _with_text(deduped.where((F.col("n_removed") == 0) | (F.trim("text") != "")), "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of least doc_id, then of least text hash; null ids come last.

    Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, checked exactly. SimHash
    anchors find the closest of them; what differs in more bits than anchors reach meets by MinHash bands. A document is told by
    its id and its text's hash, so different texts under one id, or without ids, are judged apart; of rows that repeat
    both, that of least language and source stays.
    """
    own = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("mark"))
    stay = nearcopies.first_of_near_copies(own, ["no_id", "k", "mark"]).select("k", "mark")
    kept = own.join(stay, ["k", "mark"], "left_semi")
    return kept.groupBy("k", "mark").agg(F.min(F.struct("lang", "source", "doc_id", "text", "n_chars")).alias("r")).select(*(f"r.{c}" for c in COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; documents of which nothing is left go too."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=("doc_id", "lang", "source"))
    return _with_text(found.where((F.col("n_hit") == 0) | (F.trim("clean_text") != "")), "clean_text")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them again."""
    made = bpe.encode(docs, tokenizer_json(), keep=("doc_id", "lang", "source"), pattern=split_pattern())
    return made.select("doc_id", "lang", "source", F.decode("decoded", "UTF-8").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: A learned model, near copies and BPE have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A stage's table goes once the next one's is written; the last is the result's and stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
