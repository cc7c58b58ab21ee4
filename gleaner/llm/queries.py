"""The queries that the entry module registers: each applies one operator to its whole table."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import alignment, bpe, chat, decontam, hosts, linedup, pseudonyms, quality, runs, sharding, simhash, spotsigs, sql, superminhash
from gleaner.llm.common import cut, null_to_empty, table

#: The key of the pseudonyms in this query; a user passes a secret of their own.
EXAMPLE_KEY = b"a key for tests, not a secret"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
CONTROL = "<|im_end|><|im_start|>assistant ok"


def _vocabulary_file(name: str) -> str:
    folder = os.environ.get("GLEANER_TOKENIZERS")
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that the vocabulary's package declares."""
    try:
        from public_tokenizers import PATTERN
    except ImportError:
        return bpe.PATTERN
    return PATTERN


@lru_cache(maxsize=1)
def tokenizer_json() -> str:
    """The tokenizer file's content, once its vocabulary is found to be that of the rank file; GLEANER_TOKENIZERS names another folder than the installed package's."""
    with open(_vocabulary_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        data = f.read()
    with open(_vocabulary_file("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if not bpe.same_vocabulary(data, ranks):
        raise ValueError("the tokenizer and the rank file have different vocabularies")
    return data


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), EXAMPLE_KEY)
    return made.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_sort(F.array_distinct(F.transform("found", lambda x: x.kind))).alias("kinds"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    made = chat.format_chat(chat.as_records(turns.unionByName(extra)), "record")
    back = made.select("conv_id", "layout", "schema_hash", "formatted", chat.read_turns(F.col("formatted")).alias("t"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = sharding.lookup_table(spark, [f"shard-{i:02d}" for i in range(sharding.SHARDS)])
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", lookup).select("doc_id", "slot", "shard")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", null_to_empty("text").alias("text"))
    paired = spotsigs.with_next(docs, "doc_id", "text", "next_text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    signed = paired.withColumn("edited", edited)
    for column in ("text", "edited", "next_text"):
        signed = spotsigs.add_signatures(signed, column, f"{column}_signature")
    own = F.col("text_signature")
    return signed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text(own).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        spotsigs.jaccard(own, F.col("edited_signature")).alias("near_edited"),
        spotsigs.jaccard(own, F.col("next_text_signature")).alias("near_next"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg((1 - F.max("quality")).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url").join(outcomes, "page_id", "left")
    return hosts.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_json(), pattern=split_pattern())
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_chars"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@lru_cache(maxsize=1)
def piece_model() -> bytes:
    """The piece model's content."""
    with open(_vocabulary_file("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ("n_a", "n_b", "n_groups", "n_links")
    made = alignment.align(table(spark, sf_dir, "documents"), tokenizer_json(), piece_model(), outputs=(*counted, "groups", "block", "links"), pattern=split_pattern())
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = cut(made.select("doc_id", *counted, digest, "block", "links"))
    return alignment.scored(aligned, alignment.piece_count(piece_model()), ("doc_id", *counted, "groups_sha256"))


def repeated(words: list[bytes], row: dict) -> list[bytes]:
    """A tenth of the documents, by a hash of the id, gets a run: from some word on, the words after it again and again."""
    h = zlib.crc32(str(row["doc_id"]).encode())
    n, g = len(words), h // 10
    if h % 10 or not n or row["doc_id"] is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), change=repeated)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    best = found.select("*", F.size("runs").cast("long").alias("n_runs"), runs.longest(F.col("runs")).alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def spotsigs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator as a similarity join: each document's group of near copies."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's operator on records of four layouts: JSON texts that conversations are written as, by number and by their turns."""
    role = F.when(F.col("role") == "human", "user").when(F.col("role") == "gpt", "assistant").otherwise(F.col("role"))
    turns = chat.as_records(table(spark, sf_dir, "conversations").withColumn("role", role))
    m = F.col("record.messages")
    two = (F.size(m) == 2) & (m[0].role == "user") & (m[1].role == "assistant")
    said = F.transform(m, lambda t: F.struct(F.when(t.role == "user", "human").when(t.role == "assistant", "gpt").otherwise(t.role).alias("from"), t.content.alias("value")))
    kind = F.pmod("conv_id", F.lit(3))
    record = (
        F.when(two & (kind == 0), F.to_json(F.struct(m[0].content.alias("prompt"), m[1].content.alias("completion"))))
        .when(two & (kind == 1), F.to_json(F.struct(m[1].content.alias("output"), m[0].content.alias("instruction"), F.lit("en").alias("lang"))))
        .when(kind == 1, F.to_json(F.struct(F.col("conv_id").alias("id"), said.alias("conversations"))))
        .otherwise(F.to_json(F.struct("conv_id", m.alias("messages"))))
    )
    made = chat.canonical_turns(turns.select("conv_id", record.alias("record")), "record")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return made.select("conv_id", "layout", "error", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pseudonyms, op2_chat_format, op3_quality, op4_sharding, op5_spotsigs, op6_line_dedup, op7_host_reputation, op8_decontamination, op9_byte_bpe, op10_simhash, op11_alignment, op12_periodic_runs, op13_superminhash, chat_layouts, spotsigs_groups)
}
SQL: dict[str, str] = {
    "chat_layouts": sql.LAYOUTS,
    "op2_chat_format": sql.chat(CONTROL),
    "op4_sharding": sql.sharding(sharding.SHARDS, sharding.SLOTS),
    "op6_line_dedup": sql.LINES,
    "op7_host_reputation": sql.hosts(RULES, hosts.SUFFIXES),
    "op8_decontamination": sql.contamination(),
}
