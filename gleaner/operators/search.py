"""Many questions at once over a stored index: only what their terms touch is read and scored.

The index (`gleaner.operators.segments`) has postings by language and token, the records' tokens for document
frequencies, the vocabulary with its trigrams, the chunks with their title terms, and one row of counts for each language
and category. Questions are a table. Their terms meet the vocabulary, its related tokens meet postings, and chunks join
only if a posting, a graph score or a vector brought them up, all in hash joins. Texts are read for the chunks of those
URLs alone that are among a question's best. One question is a table of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as X
from gleaner.functions import vectors as V
from gleaner.operators import nearest
from gleaner.operators.index import relate
from gleaner.operators.segments import CHUNK_COLUMNS, Index
from gleaner.storage import cut, sent

QUESTIONS = "question_id long, language string, category string, text string"


def _here(question_category: str, category: str) -> Column:
    return F.col(question_category).isNull() | (F.col(question_category) == F.col(category))


def _asked(questions: DataFrame) -> DataFrame:
    terms = X.terms(F.col("text"))
    pairs = F.when(F.size(terms) > 1, F.arrays_zip(F.slice(terms, 1, F.size(terms) - 1).alias("a"), F.slice(terms, 2, F.size(terms)).alias("b")))
    return questions.select("question_id", "language", F.col("category").alias("asked_category"), "text", F.array_distinct(terms).alias("unique"), F.coalesce(pairs, F.array().cast("array<struct<a:string,b:string>>")).alias("pairs"))


def related_tokens(index: Index, questions: DataFrame) -> DataFrame:
    """(language, term, token): the vocabulary's tokens that are related to the questions' terms, written once for all that is looked up by them."""
    return sent(relate(index.vocabulary, index.grams, _asked(questions).select("language", F.explode("unique").alias("term")).distinct()))


def term_weights(index: Index, questions: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(question_id, language, term, df, n_documents, weight): document frequencies of the tokens related to each distinct term, over the records of the question's language and category."""
    asked = _asked(questions).select("question_id", "language", "asked_category", F.explode("unique").alias("term"))
    found = index.live(index.doc_tokens.join(related_tokens(index, questions) if related is None else related, ["language", "token"]))
    by = found.select("language", "category", "term", "source_id").distinct().groupBy("language", "category", "term").agg(F.count("*").alias("df"))
    counts = asked.join(by, ["language", "term"], "left").where(F.col("category").isNull() | _here("asked_category", "category"))
    counts = counts.groupBy("question_id", "language", "term").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
    spread = asked.select("question_id", "language", "asked_category").distinct().join(index.totals, "language").where(_here("asked_category", "category"))
    total = spread.groupBy("question_id").agg(F.sum("n_documents").alias("n_documents"))
    terms = asked.select("question_id", "language", "term").join(counts, ["question_id", "language", "term"], "left").join(total, "question_id")
    return terms.select("question_id", "language", "term", F.coalesce("df", F.lit(0)).alias("df"), "n_documents").withColumn("weight", 1 + F.log((1 + F.col("n_documents")) / (1 + F.col("df"))))


def lexical_hits(index: Index, questions: DataFrame) -> DataFrame:
    """(question_id, chunk_id, coverage): the weighted share of a question's terms that a chunk has, 0.7 for its text and 0.3 for its title."""
    related = related_tokens(index, questions)
    weights = cut(term_weights(index, questions, related))
    met = index.live(index.postings.join(related, ["language", "token"]))
    hits = met.groupBy("language", "term", "chunk_id").agg(F.bool_or("in_body").alias("body"), F.bool_or("in_title").alias("title"))
    share = F.when(F.col("body"), 0.7).otherwise(0.0) + F.when(F.col("title"), 0.3).otherwise(0.0)
    total = weights.groupBy("question_id").agg(F.sum("weight").alias("total"))
    covered = weights.join(hits, ["language", "term"]).groupBy("question_id", "chunk_id").agg(F.sum(F.col("weight") * share).alias("covered"))
    return covered.join(total, "question_id").select("question_id", "chunk_id", (F.col("covered") / F.col("total")).alias("coverage"))


def _pair_bonus() -> Column:
    title = F.col("title_terms")
    two = F.arrays_zip(title.alias("a"), F.slice(title, 2, F.greatest(F.size(title), F.lit(1))).alias("b"))
    met = F.size(F.filter("pairs", lambda p: F.exists(two, lambda t: F.coalesce(X.related_columns(t["a"], p["a"]) & X.related_columns(t["b"], p["b"]), F.lit(False)))))
    return F.when(F.size("pairs") > 0, 0.1 * met / F.size("pairs")).otherwise(0.0)


def passage_scores(unique: Column, question: Column, content: Column) -> Column:
    """retrieval.passage_score() for a question that is a column: the best sentence of a content."""
    focus = F.filter(unique, lambda t: ~t.isin(*config.GENERIC_FOCUS))
    focus = F.when(F.size(focus) > 0, focus).otherwise(unique)
    defines = X.matches(question, config.DEFINITION_QUESTION)

    def score(s: Column) -> Column:
        own = s["t"]
        found = F.size(F.filter(focus, lambda f: F.exists(own, lambda t: X.related_columns(t, f))))
        subject = F.exists(focus, lambda f: F.coalesce(X.related_columns(F.get(own, F.lit(0)), f), F.lit(False)))
        n = X.word_count(s["s"])
        out = F.least(F.lit(1.0), found * 0.7 / F.size(focus)) + F.when(subject & (n >= 4), 0.15).otherwise(0.0)
        out = out + F.when(defines & subject & X.matches(s["s"], config.DEFINITION_CUE), 0.25).otherwise(0.0)
        return out * F.when((n < 4) & ~s["s"].rlike(r"[.!?]$"), 0.5).otherwise(1.0)

    with_terms = F.filter(F.transform(X.sentences(content), lambda s: F.struct(s.alias("s"), X.terms(s).alias("t"))), lambda s: F.size(s["t"]) > 0)
    return F.when(F.size(unique) > 0, F.coalesce(F.array_max(F.transform(with_terms, score)), F.lit(0.0))).otherwise(0.0)


def lexical_search(index: Index, questions: DataFrame) -> DataFrame:
    """(question_id, chunk columns, lexical_score not rounded) of the chunks that share a term with a question of their language and category."""
    met = lexical_hits(index, questions).join(_asked(questions), "question_id").join(index.chunks, ["chunk_id", "language"]).where(_here("asked_category", "category"))
    return met.select("question_id", *CHUNK_COLUMNS, F.least(F.lit(1.0), F.col("coverage") + _pair_bonus()).alias("lexical_score"))


def usable_questions(index: Index, questions: DataFrame, vectors: DataFrame, question_vectors: DataFrame) -> DataFrame:
    """question_id of those for which every candidate chunk has a valid vector of the question's length; one pass over the chunks' states."""
    kept = vectors.select("chunk_id", "checksum", "vector")
    state = index.chunks.select("chunk_id", "checksum", "language", "category").join(kept, ["chunk_id", "checksum"], "left")
    n = F.size("vector")
    by = state.groupBy("language", "category").agg(F.bool_and(F.coalesce(V.valid(F.col("vector")), F.lit(False))).alias("all"), F.min(n).alias("low"), F.max(n).alias("high"))
    asked = questions.select("question_id", "language", F.col("category").alias("asked_category")).join(question_vectors.select("question_id", F.size("vector").alias("length"), V.valid(F.col("vector")).alias("fine")), "question_id")
    met = asked.join(by, "language").where(_here("asked_category", "category"))
    return met.groupBy("question_id").agg(F.bool_and(F.col("all") & F.col("fine") & (F.col("low") == F.col("length")) & (F.col("high") == F.col("length"))).alias("usable")).where("usable").select("question_id")


def search(
    index: Index,
    questions: DataFrame,
    settings: config.Retrieval = config.Retrieval(),
    vectors: DataFrame | None = None,
    question_vectors: DataFrame | None = None,
    graph_scores: DataFrame | None = None,
    clusters: nearest.Clusters | None = None,
) -> DataFrame:
    """The best rows of each question (QUESTIONS), one for each URL, with scores, confidence and rank from 1.

    The semantics are those of retrieval.hybrid_search(). vectors (chunk_id, checksum, vector) of one model count only
    for the text they were made from; a question for which some candidate lacks a valid one is answered lexically as a
    whole and says embedding_unavailable. graph_scores (question_id, source_id, ontology_score) bring up chunks of
    their sources. A chunk without a shared term is a candidate if its similarity alone reaches the minimum score;
    clusters (nearest.clustered() of the same vectors) find those without a look at every vector.
    """
    asked = _asked(questions)
    brought = lexical_hits(index, questions)
    semantic = vectors is not None and question_vectors is not None and settings.use_semantic and settings.lexical_weight < 1
    if graph_scores is not None:
        raised = graph_scores.join(index.chunks.select("chunk_id", "source_id"), "source_id").select("question_id", "chunk_id", F.lit(0.0).alias("coverage"))
        brought = brought.unionByName(raised)
    if semantic:
        usable = usable_questions(index, questions, vectors, question_vectors)
        near = questions.select("question_id", "language").join(usable, "question_id").join(question_vectors.select("question_id", F.col("vector").alias("q")), "question_id")
        kept = index.chunks.select("chunk_id", "checksum", "language").join(vectors.select("chunk_id", "checksum", "vector"), ["chunk_id", "checksum"])
        like = F.greatest(F.lit(0.0), V.cosine(F.col("vector"), F.col("q"))).alias("semantic")
        # a chunk that only its vector brings up has a lexical score of 0, so its likeness alone must reach the minimum
        enough = max((settings.minimum_score - 5e-5) / (1 - settings.lexical_weight), 0.0) - 1e-9
        if clusters is None:
            alike = near.join(kept, "language").select("question_id", "chunk_id", like).where(F.col("semantic") >= enough)
        else:
            alike = nearest.within(clusters, near.select("question_id", "language", F.col("q").alias("vector")), enough).select("question_id", "chunk_id", F.greatest(F.lit(0.0), F.col("similarity")).alias("semantic"))
        known = brought.select("question_id", "chunk_id").distinct().join(near, "question_id").join(kept, ["chunk_id", "language"]).select("question_id", "chunk_id", like)
        brought = brought.select("question_id", "chunk_id", "coverage", F.lit(0.0).alias("semantic")).unionByName(alike.unionByName(known).withColumn("coverage", F.lit(0.0)))
        brought = brought.groupBy("question_id", "chunk_id").agg(F.max("coverage").alias("coverage"), F.max("semantic").alias("semantic"))
        brought = brought.join(usable.withColumn("hybrid", F.lit(True)), "question_id", "left").withColumn("hybrid", F.coalesce("hybrid", F.lit(False)))
    else:
        brought = brought.groupBy("question_id", "chunk_id").agg(F.max("coverage").alias("coverage"), F.lit(0.0).alias("semantic"), F.lit(False).alias("hybrid"))
    about = asked.select("question_id", "language", "asked_category", "pairs", F.size("unique").alias("n_terms"), X.matches(F.col("text"), config.PLACEHOLDER_NOTICE).alias("about"))
    placed = index.chunks.select("chunk_id", "source_id", "canonical_url", "category", "language", "title_terms")
    rows = brought.join(about, "question_id").join(placed, ["chunk_id", "language"]).where((F.col("n_terms") > 0) & _here("asked_category", "category"))
    if graph_scores is not None:
        rows = rows.join(graph_scores.select("question_id", "source_id", F.col("ontology_score").alias("graph")), ["question_id", "source_id"], "left")
    rows = rows.withColumn("graph", F.coalesce(F.col("graph") if graph_scores is not None else F.lit(0.0), F.lit(0.0)))
    lexical = F.least(F.lit(1.0), F.col("coverage") + _pair_bonus())
    blend = F.when(F.col("hybrid"), settings.lexical_weight * F.col("lexical") + (1 - settings.lexical_weight) * F.col("semantic")).otherwise(F.col("lexical"))
    rows = rows.withColumn("lexical", lexical).join(index.placeholders.select("source_id", F.lit(True).alias("thin")), "source_id", "left")
    rows = rows.withColumn("quality", F.when(F.col("thin") & ~F.col("about"), 0.45).otherwise(1.0)).withColumn("combined", F.greatest(blend, F.col("graph")) * F.col("quality"))
    rows = rows.where((F.col("combined") > 0) & (X.rounded(F.col("combined")) >= settings.minimum_score))
    reason = F.when(~F.col("hybrid"), "embedding_unavailable") if semantic else F.lit(None).cast("string")
    scored = rows.select(
        "question_id",
        "chunk_id",
        "source_id",
        "canonical_url",
        X.rounded(F.col("combined")).alias("score"),
        X.rounded(F.col("lexical")).alias("lexical_score"),
        X.rounded(F.col("semantic")).alias("semantic_score"),
        F.col("graph").alias("ontology_score"),
        F.col("quality").alias("page_quality_factor"),
        X.confidence(F.col("combined")).alias("confidence"),
        F.when(F.col("hybrid"), "hybrid").otherwise("lexical").alias("search_mode"),
        reason.alias("fallback_reason"),
    )
    top = sent(of_best_urls(cut(scored), settings.result_limit))
    texts = index.chunks.select("chunk_id", *(c for c in CHUNK_COLUMNS if c not in ("chunk_id", "source_id", "canonical_url")))
    read = texts.join(top, "chunk_id").join(asked.select("question_id", "unique", "text"), "question_id")
    read = read.withColumn("passage_score", X.rounded(passage_scores(F.col("unique"), F.col("text"), F.col("content"))))
    of_url = Window.partitionBy("question_id", "canonical_url").orderBy(F.desc("passage_score"), *_order())
    best = read.withColumn("__n", F.row_number().over(of_url)).where("__n = 1")
    shown = [c for c in scored.columns if c not in ("question_id", "search_mode", "fallback_reason", *CHUNK_COLUMNS)]
    return best.select("question_id", *CHUNK_COLUMNS, *shown, "passage_score", "search_mode", "fallback_reason", "rank")


def _order() -> list[Column]:
    return [F.desc("score"), F.desc("lexical_score"), F.desc("ontology_score"), F.col("source_id"), F.col("chunk_id")]


def of_best_urls(scored: DataFrame, limit: int) -> DataFrame:
    """The rows of each question's best `limit` URLs, with their URL's rank, which is that of its best-scored row.

    Spark keeps `limit` ranks of each task's rows before they meet, so a question with many hits is no large group.
    """
    key = F.struct(-F.col("score"), -F.col("lexical_score"), -F.col("ontology_score"), "source_id", "chunk_id")
    urls = scored.groupBy("question_id", "canonical_url").agg(F.min(key).alias("__key"))
    ranked = urls.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("__key"))).where(F.col("rank") <= limit)
    return scored.join(ranked.drop("__key"), ["question_id", "canonical_url"])


def admin_rows(results: DataFrame) -> DataFrame:
    """What an administrator's search shows of results."""
    shown = ("question_id", "rank", "source_id", "chunk_id", "title", "canonical_url", "category", "language", "content", "checksum", "score", "lexical_score", "semantic_score", "ontology_score", "confidence")
    return results.select(*(c for c in shown if c in results.columns))


def tool_search(index: Index, questions: DataFrame, relationships: DataFrame, aliases: DataFrame, settings: config.Retrieval = config.Retrieval(), **kw) -> DataFrame:
    """search() with the scores that the graph gives to sources: 0.6 one step from what a question names, 0.4 two steps."""
    from gleaner.operators import graph

    urls = index.chunks.select("source_id", "canonical_url", "language").distinct()
    walked = graph.bounded_search(relationships, aliases, questions.select(F.col("question_id").alias("query_id"), F.left("text", F.lit(500)).alias("text"), "language"), urls, settings.graph_depth)
    scores = walked.select(F.col("query_id").alias("question_id"), "source_id", "ontology_score")
    return search(index, questions, settings, graph_scores=scores, **kw)


def confident(results: DataFrame, minimum: float = 0.2) -> DataFrame:
    """Results that are sure enough to be evidence."""
    return results.where(F.col("score") >= minimum)
