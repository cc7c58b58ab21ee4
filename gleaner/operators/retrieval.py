"""Lexical, vector and hybrid search over records or chunks.

One question is a handful of terms, so its matches are boolean columns that one pass over the candidates computes;
no token is shuffled. The document frequencies are sums of such columns over the records: one row, broadcast.
Many questions at once go through the postings of `gleaner.operators.index`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as X
from gleaner.functions import vectors as V

RANK = ("score", "lexical_score", "ontology_score")


def _hits(tokens: Column, terms: list[str]) -> list[Column]:
    return [F.exists(tokens, _is(term)) for term in terms]


def _is(term: str):
    return lambda t: X.related(t, term)


def _are(a: str, b: str):
    return lambda p: F.coalesce(X.related(p["a"], a) & X.related(p["b"], b), F.lit(False))


def _equals(term: str):
    return lambda t: t == term


def document_frequencies(records: DataFrame, query: str) -> DataFrame:
    """One row for each distinct query term: (term, df, n_documents, weight) over titles and contents of the records."""
    terms = list(dict.fromkeys(X.query_terms(query)))
    if not terms:
        return records.sparkSession.createDataFrame([], "term string, df long, n_documents long, weight double")
    tokens = records.select(X.terms(F.concat_ws(" ", "title", "content")).alias("tokens"))
    found = tokens.select(*(h.alias(f"h{i}") for i, h in enumerate(_hits(F.col("tokens"), terms))))
    sums = found.agg(F.count("*").alias("n"), *(F.count_if(f"h{i}").alias(f"d{i}") for i in range(len(terms))))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"d{i}").alias("df")) for i, t in enumerate(terms))))
    out = sums.select(F.col("n").alias("n_documents"), rows.alias("r")).select("r.term", "r.df", "n_documents")
    return out.withColumn("weight", 1 + F.log((1 + F.col("n_documents")) / (1 + F.col("df"))))


def relevance(query_terms: list[str], title: Column, body: Column, weight: dict[str, Column] | None = None) -> Column:
    """Weighted share of the distinct terms found, 0.7 for the body and 0.3 for the title, with up to 0.1 for title pairs; at most 1."""
    unique = list(dict.fromkeys(query_terms))
    if not unique:
        return F.lit(0.0)
    weight = weight or {t: F.lit(1.0) for t in unique}
    total = weight[unique[0]]
    for t in unique[1:]:
        total = total + weight[t]
    covered = F.lit(0.0)
    for t, in_body, in_title in zip(unique, _hits(body, unique), _hits(title, unique)):
        covered = covered + weight[t] * (F.when(in_body, 0.7).otherwise(0.0) + F.when(in_title, 0.3).otherwise(0.0))
    pairs = list(zip(query_terms, query_terms[1:]))
    score = covered / total
    if pairs:
        two = F.arrays_zip(title.alias("a"), F.slice(title, 2, F.greatest(F.size(title), F.lit(1))).alias("b"))
        met = F.lit(0)
        for a, b in pairs:
            met = met + F.exists(two, _are(a, b)).cast("int")
        score = score + 0.1 * met / len(pairs)
    return F.least(F.lit(1.0), score)


def passage_score(query: str, content: Column) -> Column:
    """The best sentence's score: term coverage, more if its subject is asked for or it defines, half if it is a fragment."""
    terms = X.query_terms(query)
    focus = [t for t in terms if t not in config.GENERIC_FOCUS] or terms
    if not focus:
        return F.lit(0.0)
    defines = re.match(config.DEFINITION_QUESTION, query, re.I) is not None

    def score(s: Column) -> Column:
        own = s["t"]
        found = F.lit(0.0)
        unique = list(dict.fromkeys(focus))
        for h in _hits(own, unique):
            found = found + F.when(h, 0.7).otherwise(0.0)
        base = F.least(F.lit(1.0), found / len(unique))
        subject = F.lit(False)
        for t in unique:
            subject = subject | X.related(F.get(own, F.lit(0)), t)
        n = X.word_count(s["s"])
        out = base + F.when(subject & (n >= 4), 0.15).otherwise(0.0)
        if defines:
            out = out + F.when(subject & X.matches(s["s"], config.DEFINITION_CUE), 0.25).otherwise(0.0)
        return out * F.when((n < 4) & ~s["s"].rlike(r"[.!?]$"), 0.5).otherwise(1.0)

    with_terms = F.filter(F.transform(X.sentences(content), lambda s: F.struct(s.alias("s"), X.terms(s).alias("t"))), lambda s: F.size(s["t"]) > 0)
    return F.coalesce(F.array_max(F.transform(with_terms, score)), F.lit(0.0))


def lexical_scores(candidates: DataFrame, records: DataFrame, query: str) -> DataFrame:
    """candidates with lexical_score (not rounded) added; rows without a match are dropped."""
    terms = X.query_terms(query)
    if not terms:
        return candidates.withColumn("lexical_score", F.lit(0.0)).limit(0)
    unique = list(dict.fromkeys(terms))
    weights = document_frequencies(records, query).agg(*(F.max(F.when(F.col("term") == t, F.col("weight"))).alias(f"__w{i}") for i, t in enumerate(unique)))
    scored = candidates.withColumns({"__title": X.terms(F.col("title")), "__body": X.terms(F.col("content"))}).crossJoin(F.broadcast(weights))  # one row
    value = relevance(terms, F.col("__title"), F.col("__body"), {t: F.col(f"__w{i}") for i, t in enumerate(unique)})
    return scored.select(*candidates.columns, value.alias("lexical_score")).where("lexical_score > 0")


def hybrid_search(
    candidates: DataFrame,
    records: DataFrame,
    query: str,
    language: str,
    category: str | None = None,
    settings: config.Retrieval = config.Retrieval(),
    vectors: DataFrame | None = None,
    query_vector: list[float] | None = None,
    graph_scores: DataFrame | None = None,
) -> DataFrame:
    """The best rows for a question, one for each URL, with their scores and confidence.

    candidates are chunks (chunk_id, source_id, title, canonical_url, category, language, content); records the whole
    sources, over which document frequencies and placeholder pages are told. vectors (chunk_id, checksum, vector), of one
    model, make the search hybrid; a vector whose checksum isn't its chunk's is stale and doesn't count. If any candidate lacks a valid one of the question's length, the whole question is answered
    lexically and fallback_reason says embedding_unavailable. graph_scores (source_id, ontology_score) raise a
    source's score. Of a URL's rows the one of best passage stands in the place of the first.
    """
    terms = X.query_terms(query)
    here = (F.col("language") == language) & (F.lit(True) if category is None else F.col("category") == category)
    candidates, records = candidates.where(here), records.where(here)
    if not terms:
        candidates = candidates.limit(0)
        terms = [""]
    unique = list(dict.fromkeys(terms))
    weights = document_frequencies(records, query).agg(*(F.max(F.when(F.col("term") == t, F.col("weight"))).alias(f"__w{i}") for i, t in enumerate(unique)))
    rows = candidates.withColumns({"__title": X.terms(F.col("title")), "__body": X.terms(F.col("content"))}).crossJoin(F.broadcast(weights))  # one row
    rows = rows.withColumn("__lexical", relevance(terms, F.col("__title"), F.col("__body"), {t: F.col(f"__w{i}") for i, t in enumerate(unique)}))
    semantic = vectors is not None and query_vector is not None and settings.use_semantic and settings.lexical_weight < 1
    if semantic:
        asked = F.array(*(F.lit(float(x)) for x in query_vector))
        usable = V.valid(F.col("vector")) & (F.size("vector") == len(query_vector))
        on = [c for c in ("chunk_id", "checksum") if c in vectors.columns and c in candidates.columns]
        vectors = vectors.select(*on, "vector")
        checked = candidates.select(*on).join(vectors, on, "left")
        all_usable = checked.agg(F.bool_and(F.coalesce(usable, F.lit(False))).alias("__usable"))  # one row for the whole question
        rows = rows.join(vectors, on, "left").crossJoin(F.broadcast(all_usable))
        rows = rows.withColumn("__semantic", F.when(F.col("__usable"), F.greatest(F.lit(0.0), V.cosine(F.col("vector"), asked))).otherwise(0.0))
        blend = F.when(F.col("__usable"), settings.lexical_weight * F.col("__lexical") + (1 - settings.lexical_weight) * F.col("__semantic")).otherwise(F.col("__lexical"))
        mode, reason = F.when(F.col("__usable"), "hybrid").otherwise("lexical"), F.when(~F.col("__usable"), "embedding_unavailable")
    else:
        rows = rows.withColumn("__semantic", F.lit(0.0))
        blend, mode, reason = F.col("__lexical"), F.lit("lexical"), F.lit(None).cast("string")
    if graph_scores is not None:
        rows = rows.join(graph_scores.select("source_id", F.col("ontology_score").alias("__graph")), "source_id", "left")
    else:
        rows = rows.withColumn("__graph", F.lit(0.0))
    quality = records.select("source_id", X.page_quality(F.col("content"), query).alias("__quality")).where("__quality < 1")  # placeholders only
    rows = rows.join(quality, "source_id", "left").withColumn("__quality", F.coalesce("__quality", F.lit(1.0)))
    graph = F.coalesce("__graph", F.lit(0.0))
    rows = rows.withColumn("__combined", F.greatest(blend, graph) * F.col("__quality"))
    rows = rows.where((F.col("__combined") > 0) & (X.rounded(F.col("__combined")) >= settings.minimum_score))
    scored = rows.select(
        *candidates.columns,
        X.rounded(F.col("__combined")).alias("score"),
        X.rounded(F.col("__lexical")).alias("lexical_score"),
        X.rounded(F.col("__semantic")).alias("semantic_score"),
        graph.alias("ontology_score"),
        F.col("__quality").alias("page_quality_factor"),
        X.confidence(F.col("__combined")).alias("confidence"),
        X.rounded(passage_score(query, F.col("content"))).alias("passage_score"),
        mode.alias("search_mode"),
        reason.alias("fallback_reason"),
    )
    return best_per_url(scored).orderBy("rank").limit(settings.result_limit)


def best_per_url(scored: DataFrame) -> DataFrame:
    """One row for each canonical_url: that of best passage, ranked where the URL's best-scored row is.

    rank compares rows by score, lexical and graph score (descending), source and chunk id. Rows of a URL are first
    compared within the URL, so only one row for each URL enters the order over all.
    """
    order = [F.desc("score"), F.desc("lexical_score"), F.desc("ontology_score"), "source_id", "chunk_id"]
    by_rank = Window.partitionBy("canonical_url").orderBy(*order)
    key = F.struct(*(-F.col(c) for c in RANK), "source_id", "chunk_id")
    placed = scored.withColumn("__at", F.row_number().over(by_rank)).withColumn("__key", F.first(key).over(by_rank))
    best = Window.partitionBy("canonical_url").orderBy(F.desc("passage_score"), "__at")
    return placed.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__at").withColumnRenamed("__key", "rank")


def lexical_v1(records: DataFrame, query: str, limit: int = 4) -> DataFrame:
    """The older score: three for each term in the title and its body occurrences up to three, by three times the terms, at most 1."""
    terms = X.query_terms(query, config.STOP_WORDS_V1)
    if not terms:
        return records.withColumn("score", F.lit(0.0)).limit(0)
    title, body = X.terms(F.col("title"), config.STOP_WORDS_V1), X.terms(F.col("content"), config.STOP_WORDS_V1)
    rows = records.withColumns({"__t": title, "__b": body})
    total = F.lit(0)
    for t in dict.fromkeys(terms):
        total = total + F.when(F.array_contains("__t", t), 3).otherwise(0) + F.least(F.lit(3), F.size(F.filter("__b", _equals(t))))
    value = F.least(F.lit(1.0), total / (3.0 * len(set(terms))))
    return rows.select(*records.columns, value.alias("score")).where("score > 0").orderBy(F.desc("score"), "source_id").limit(limit)


def nearest(vectors: DataFrame, query_vector: list[float], k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """The k vectors of greatest cosine with the question's, which is not below 0; ties by id."""
    asked = F.array(*(F.lit(float(x)) for x in query_vector))
    near = F.greatest(F.lit(0.0), V.cosine(F.col(vector_col), asked))
    return vectors.where(V.valid(F.col(vector_col))).select(id_col, near.alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def vector_upsert(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """cache with the valid rows of fresh in place of those with the same keys."""
    good = fresh.where(V.valid(F.col("vector")))
    return cache.join(good.select(*keys).distinct(), keys, "left_anti").unionByName(good)


def vectors_of(vectors: DataFrame, model: str) -> DataFrame:
    """The vectors (model, chunk_id, checksum, vector) of one model."""
    return vectors.where(F.col("model") == model).drop("model")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks for whose present text a model has no vector."""
    return chunks.join(vectors_of(vectors, model).select("chunk_id", "checksum"), ["chunk_id", "checksum"], "left_anti").select(*chunks.columns)


def pruned_vectors(vectors: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """The vectors of the model and of present texts of the chunks; all others go."""
    return vectors.where(F.col("model") == model).join(chunks.select("chunk_id", "checksum"), ["chunk_id", "checksum"], "left_semi").select(*vectors.columns)


def vector_status(vectors: DataFrame) -> DataFrame:
    """(model, n, dimensions): dimensions is null unless all of a model's vectors have the same."""
    n = F.size("vector")
    return vectors.groupBy("model").agg(F.count("*").alias("n"), F.when(F.min(n) == F.max(n), F.min(n)).cast("long").alias("dimensions"))


def complete_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """vectors, if every chunk has exactly one, all valid and of one length; ValueError otherwise. A full replacement is all or nothing."""
    n = F.size("vector")
    met = chunks.select("chunk_id", "checksum").join(vectors.select("chunk_id", "checksum", "vector"), ["chunk_id", "checksum"], "full")
    got = met.agg(F.count("*").alias("rows"), F.count_if(V.valid(F.col("vector"))).alias("valid"), F.min(n).alias("low"), F.max(n).alias("high")).first()
    if not got.rows or got.valid != got.rows or got.low != got.high or met.count() != chunks.count():
        raise ValueError("complete valid vectors are required")
    return vectors


def embedded(chunks: DataFrame, provider: Callable[[list[str]], list[tuple[int, list[float]]]], model: str, batch: int = 32, text_col: str = "content") -> DataFrame:
    """(model, chunk_id, checksum, vector) of a provider that takes texts and returns (index, vector) pairs in any order.

    Texts go out `batch` at a time from each task. A text for which the provider gives no vector has none here.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                found = dict(provider(part.column(2).to_pylist()))
                vectors = pa.array([found.get(i) for i in range(part.num_rows)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([model] * part.num_rows, pa.string()), part.column(0), part.column(1), vectors], ["model", "chunk_id", "checksum", "vector"])

    out = chunks.select("chunk_id", "checksum", text_col).mapInArrow(made, "model string, chunk_id string, checksum string, vector array<double>")
    return out.where("vector IS NOT NULL")
