"""Queries of search and vectors."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as X
from gleaner.functions import vectors as V
from gleaner.operators import answers, index, nearest, retrieval, search, segments
from gleaner.plans.base import RECORDS, asked, query, r6, r6_sql, records, related_sql, sentences_sql, stored_index, table, terms_sql, words_sql
from gleaner.storage import cut, work_folder

QUESTION = "What is the thereation of eredon"
TERMS = X.query_terms(QUESTION)
_UNIQUE = list(dict.fromkeys(TERMS))


def _hit(tokens: str, term: str) -> str:
    return f"len(list_filter({tokens}, lambda t: {related_sql('t', term)})) > 0"


def _relevance_sql(terms: list[str], title: str, body: str, weight: str = "w{}") -> str:
    unique = list(dict.fromkeys(terms))
    covered = " + ".join(f"{weight.format(i)} * (CASE WHEN {_hit(body, t)} THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN {_hit(title, t)} THEN 0.3::DOUBLE ELSE 0 END)" for i, t in enumerate(unique))
    total = " + ".join(weight.format(i) for i in range(len(unique)))
    pairs = list(zip(terms, terms[1:]))
    met = " + ".join(f"(len(list_filter(range(1, len({title})), lambda i: {related_sql(f'{title}[i]', a)} AND {related_sql(f'{title}[i+1]', b)})) > 0)::INT" for a, b in pairs)
    return f"least(1.0::DOUBLE, (0.0 + {covered}) / ({total})" + (f" + 0.1::DOUBLE * ({met}) / {len(pairs)}" if pairs else "") + ")"


_TOKENS = f"""{RECORDS}, tok AS (SELECT *, {terms_sql('title', config.STOP_WORDS)} AS tt, {terms_sql('content', config.STOP_WORDS)} AS tb FROM records WHERE language = 'en'),
  df AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER ({_hit('tb', t)} OR {_hit('tt', t)}) AS d{i}" for i, t in enumerate(_UNIQUE))} FROM tok),
  w AS (SELECT {", ".join(f"1 + ln((1 + n)::DOUBLE / (1 + d{i})) AS w{i}" for i in range(len(_UNIQUE)))} FROM df),
  lex AS (SELECT tok.*, {_relevance_sql(TERMS, 'tt', 'tb')} AS lexical FROM tok, w)"""


@query(f"WITH {_TOKENS} SELECT source_id, {r6_sql('lexical')} AS score, CASE WHEN lexical >= 0.7 THEN 'high' WHEN lexical >= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM lex WHERE lexical > 0 AND {r6_sql('lexical', 4)} >= 0.2 ORDER BY {r6_sql('lexical', 4)} DESC, source_id LIMIT 4")
def lexical_topk(spark, sf_dir):
    """The flagship: English records for a free-text question, by weighted coverage of related tokens."""
    scored = search.lexical_search(stored_index(spark, sf_dir), asked(spark, {1: QUESTION})).where(X.rounded(F.col("lexical_score")) >= 0.2)
    top = scored.orderBy(F.desc(X.rounded(F.col("lexical_score"))), "source_id").limit(4)
    return top.select("source_id", r6(F.col("lexical_score")).alias("score"), X.confidence(F.col("lexical_score")).alias("confidence"))


@query(f"WITH {_TOKENS} SELECT source_id, {r6_sql('lexical')} AS lexical_score FROM lex WHERE lexical > 0")
def lexical_scores(spark, sf_dir):
    r = records(spark, sf_dir).where("language = 'en'")
    return retrieval.lexical_scores(r, r, QUESTION).select("source_id", r6(F.col("lexical_score")).alias("lexical_score"))


@query(f"WITH {_TOKENS} " + " UNION ALL ".join(f"SELECT '{t}' AS term, d{i} AS df, n AS n_documents, {r6_sql(f'w{i}')} AS weight FROM df, w" for i, t in enumerate(_UNIQUE)))
def term_df_idf(spark, sf_dir):
    return search.term_weights(stored_index(spark, sf_dir), asked(spark, {1: QUESTION})).select("term", "df", "n_documents", r6(F.col("weight")).alias("weight"))


_V1 = X.query_terms("the entreation of tion", config.STOP_WORDS_V1)


@query(
    f"""WITH {RECORDS}, t AS (SELECT source_id, {terms_sql('title', config.STOP_WORDS_V1)} AS tt, {terms_sql('content', config.STOP_WORDS_V1)} AS tb FROM records WHERE language = 'en'),
    s AS (SELECT source_id, least(1.0::DOUBLE, ({" + ".join(f"CASE WHEN list_contains(tt, '{t}') THEN 3 ELSE 0 END + least(3, len(list_filter(tb, lambda x: x = '{t}')))" for t in dict.fromkeys(_V1))})::DOUBLE / (3.0 * {len(set(_V1))})) AS score FROM t)
    SELECT source_id, {r6_sql('score')} AS score FROM s WHERE score > 0 ORDER BY score DESC, source_id LIMIT 20"""
)
def lexical_v1_topk(spark, sf_dir):
    r = records(spark, sf_dir).where("language = 'en'")
    return retrieval.lexical_v1(r, "the entreation of tion", 20).select("source_id", r6(F.col("score")).alias("score"))


def _passage_sql(question: str, content: str) -> str:
    terms = X.query_terms(question)
    focus = list(dict.fromkeys([t for t in terms if t not in config.GENERIC_FOCUS] or terms))
    own = terms_sql("s", config.STOP_WORDS)
    found = " + ".join(f"CASE WHEN {_hit('t', f)} THEN 0.7::DOUBLE ELSE 0 END" for f in focus)
    subject = " OR ".join(related_sql("t[1]", f) for f in focus)
    cue = r"(^|[^\p{L}\p{N}_])(is|are|helps?|provides?|enables?|är|hjälper|erbjuder)([^\p{L}\p{N}_]|$)"
    define = f" + CASE WHEN ({subject}) AND regexp_matches(s, '(?i){cue}') THEN 0.25::DOUBLE ELSE 0 END" if re.match(config.DEFINITION_QUESTION, question, re.I) else ""
    score = f"(least(1.0::DOUBLE, (0.0 + {found}) / {len(focus)}) + CASE WHEN ({subject}) AND len({words_sql('s')}) >= 4 THEN 0.15::DOUBLE ELSE 0 END{define}) * CASE WHEN len({words_sql('s')}) < 4 AND NOT regexp_matches(s, '[.!?]$') THEN 0.5::DOUBLE ELSE 1 END"
    return f"""sen AS (SELECT key, unnest({sentences_sql(content)}) AS s FROM src), sent AS (SELECT key, s, {own} AS t FROM sen), best AS (SELECT key, max({score}) AS passage FROM sent WHERE len(t) > 0 GROUP BY key)"""


@query(f"WITH {RECORDS}, src AS (SELECT source_id AS key, content FROM records WHERE language = 'en'), {_passage_sql(QUESTION, 'content')} SELECT src.key AS source_id, {r6_sql('coalesce(passage, 0.0)')} AS passage_score FROM src LEFT JOIN best USING (key)")
def passage_score_best(spark, sf_dir):
    r = records(spark, sf_dir).where("language = 'en'")
    return r.select("source_id", r6(retrieval.passage_score(QUESTION, F.col("content"))).alias("passage_score"))


@query(
    f"""WITH {_TOKENS}, ranked AS (SELECT source_id, canonical_url, content, {r6_sql('lexical', 4)} AS score FROM lex WHERE lexical > 0 AND {r6_sql('lexical', 4)} >= 0.2),
    src AS (SELECT source_id AS key, content FROM ranked), {_passage_sql(QUESTION, 'content')},
    p AS (SELECT r.*, {r6_sql('coalesce(passage, 0.0)', 4)} AS passage_score, row_number() OVER (ORDER BY score DESC, source_id) AS rk FROM ranked r LEFT JOIN best ON best.key = r.source_id),
    u AS (SELECT *, min(rk) OVER (PARTITION BY canonical_url) AS first_rk, row_number() OVER (PARTITION BY canonical_url ORDER BY passage_score DESC, rk) AS n FROM p)
    SELECT canonical_url, source_id, score, passage_score FROM u WHERE n = 1 ORDER BY first_rk LIMIT 4"""
)
def best_chunk_per_url(spark, sf_dir):
    found = search.search(stored_index(spark, sf_dir), asked(spark, {1: QUESTION}))
    return found.select("canonical_url", "source_id", "score", "passage_score")


_VECTOR = "(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def _asked(spark, sf_dir) -> list[float]:
    return list(_vectors(spark, sf_dir).where("vec_id = 7").first().vector)


@query(f"SELECT vec_id, {r6_sql('greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], v))')} AS similarity FROM embeddings, {_VECTOR} ORDER BY greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], v)) DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return retrieval.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10).select("vec_id", r6(F.col("similarity")).alias("similarity"))


#: A document without an embedding gets this vector, which both engines make from its number.
_MADE = "list_transform(range(64), lambda i: ((doc_id * 31 + i * 17) % 101 - 50) / 50.0::DOUBLE)"
_BLEND = "0.65::DOUBLE * lexical + 0.35::DOUBLE * semantic"
_GRAPH = "CASE WHEN doc_id % 50 = 0 THEN 0.6::DOUBLE ELSE 0 END"
_RANKED = f"""ranked AS (SELECT *, {r6_sql('combined', 4)} AS score FROM c WHERE combined > 0 AND {r6_sql('combined', 4)} >= 0.2), src AS (SELECT source_id AS key, content FROM ranked)"""
_BEST = f"""p AS (SELECT r.*, {r6_sql('coalesce(passage, 0.0)', 4)} AS passage_score, row_number() OVER (ORDER BY score DESC, {r6_sql('lexical', 4)} DESC, graph DESC, source_id) AS rk FROM ranked r LEFT JOIN best ON best.key = r.source_id),
    u AS (SELECT *, min(rk) OVER (PARTITION BY canonical_url) AS first_rk, row_number() OVER (PARTITION BY canonical_url ORDER BY passage_score DESC, rk) AS n FROM p)"""


def _own_vectors(spark, sf_dir):
    """(chunk_id, checksum, vector) of the documents that have embeddings."""
    named = records(spark, sf_dir).select(F.col("source_id").alias("chunk_id"), "checksum")
    return _vectors(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("chunk_id"), "vector").join(named, "chunk_id").select("chunk_id", "checksum", "vector")


def _provider(texts):
    """Stands for a model: a vector for each text, in another order than asked."""
    return [(k, [float(((int(t.split("_")[-1]) * 31 + i * 17) % 101 - 50)) / 50.0 for i in range(64)]) for k, t in reversed(list(enumerate(texts)))]


def _all_vectors(spark, sf_dir):
    """Every document's vector: its embedding, or what the provider makes for those that lack one."""
    own = _own_vectors(spark, sf_dir).withColumn("model", F.lit("m"))
    r = records(spark, sf_dir).select(F.col("source_id").alias("chunk_id"), "checksum", F.col("source_id").alias("content"))
    fresh = retrieval.embedded(retrieval.missing_vectors(r, own, "m"), _provider, "m")
    return retrieval.vector_upsert(own, fresh.select(*own.columns), ["model", "chunk_id", "checksum"]).drop("model")


def _graph_scores(spark, sf_dir):
    n = F.substring_index("source_id", "_", -1).cast("long")
    return records(spark, sf_dir).where(n % 50 == 0).select(F.lit(1).cast("long").alias("question_id"), "source_id", F.lit(0.6).alias("ontology_score"))


def _hybrid(spark, sf_dir, vectors):
    asked_vector = spark.createDataFrame([(1, _asked(spark, sf_dir))], "question_id long, vector array<double>")
    return search.search(stored_index(spark, sf_dir), asked(spark, {1: QUESTION}), vectors=cut(vectors), question_vectors=asked_vector, graph_scores=_graph_scores(spark, sf_dir))


@query(
    f"""WITH {_TOKENS}, c AS (SELECT *, greatest({_BLEND}, graph) AS combined FROM (SELECT lex.*, {_GRAPH} AS graph, greatest(0.0, list_cosine_similarity(coalesce(embedding::DOUBLE[], {_MADE}), v)) AS semantic FROM lex LEFT JOIN embeddings ON vec_id = lex.doc_id, {_VECTOR})),
    {_RANKED}, {_passage_sql(QUESTION, 'content')}, {_BEST}
    SELECT source_id, score, {r6_sql('lexical', 4)} AS lexical_score, {r6_sql('semantic', 4)} AS semantic_score, graph AS ontology_score, passage_score, 'hybrid' AS search_mode, NULL AS fallback_reason FROM u WHERE n = 1 ORDER BY first_rk LIMIT 4"""
)
def hybrid_topk(spark, sf_dir):
    """All English documents, each with a vector of its own or of the provider."""
    return _hybrid(spark, sf_dir, _all_vectors(spark, sf_dir)).select("source_id", "score", "lexical_score", "semantic_score", "ontology_score", "passage_score", "search_mode", "fallback_reason")


#: Some documents lose their vector at every scale.
_KEEPS = "vec_id % 7 <> 3"


@query(
    f"""WITH {_TOKENS}, own AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_KEEPS}), usable AS (SELECT bool_and(vec_id IS NOT NULL) AS ok FROM tok LEFT JOIN own ON vec_id = doc_id),
    c AS (SELECT *, greatest(CASE WHEN ok THEN {_BLEND} ELSE lexical END, graph) AS combined FROM (SELECT lex.*, {_GRAPH} AS graph, ok, CASE WHEN ok THEN greatest(0.0, list_cosine_similarity(e, v)) ELSE 0.0::DOUBLE END AS semantic FROM lex LEFT JOIN own ON vec_id = doc_id, usable, {_VECTOR})),
    {_RANKED}, {_passage_sql(QUESTION, 'content')}, {_BEST}
    SELECT source_id, score, {r6_sql('semantic', 4)} AS semantic_score, CASE WHEN ok THEN 'hybrid' ELSE 'lexical' END AS search_mode, CASE WHEN NOT ok THEN 'embedding_unavailable' END AS fallback_reason FROM u WHERE n = 1 ORDER BY first_rk LIMIT 4"""
)
def hybrid_fallback(spark, sf_dir):
    """The same with a part of the stored embeddings alone: while a document lacks one, the whole question is answered lexically."""
    own = _own_vectors(spark, sf_dir).where(F.substring_index("chunk_id", "_", -1).cast("long") % 7 != 3)
    return _hybrid(spark, sf_dir, own).select("source_id", "score", "semantic_score", "search_mode", "fallback_reason")


@query(
    f"""WITH {_TOKENS}, c AS (SELECT *, lexical AS combined, 0.0::DOUBLE AS graph FROM lex), {_RANKED}, {_passage_sql(QUESTION, 'content')}, {_BEST}
    SELECT source_id, title, canonical_url, category, language, checksum, score, {r6_sql('lexical', 4)} AS lexical_score, CASE WHEN combined >= 0.7 THEN 'high' WHEN combined >= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM u WHERE n = 1 ORDER BY first_rk LIMIT 4"""
)
def admin_search(spark, sf_dir):
    """What an administrator's search shows."""
    found = search.admin_rows(search.confident(search.search(stored_index(spark, sf_dir), asked(spark, {1: QUESTION}))))
    return found.select("source_id", "title", "canonical_url", "category", "language", "checksum", "score", "lexical_score", "confidence")


@query(
    f"""WITH q AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT question_id, vec_id, greatest(-1.0, list_cosine_similarity(embedding::DOUBLE[], v)) AS similarity FROM q, embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT question_id, vec_id, rank, {r6_sql('similarity')} AS similarity FROM k WHERE rank <= 10"""
)
def vectors_topk_many(spark, sf_dir):
    """The ten nearest vectors of many questions: every fiftieth vector asks, against all of them, without a look at each pair."""
    v = _vectors(spark, sf_dir).withColumn("language", F.lit("all"))
    made = nearest.clustered(v, "vec_id")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "language", "vector")
    found = nearest.top_k(made, asked, 10)
    return found.select("question_id", F.col("chunk_id").alias("vec_id"), "rank", r6(F.col("similarity")).alias("similarity"))


@query("SELECT vec_id, label % 3 <> 0 AND label % 5 <> 1 AS valid FROM embeddings")
def vector_validity(spark, sf_dir):
    """Vectors of which some are made empty and some all zeros."""
    v = _vectors(spark, sf_dir)
    spoiled = F.when(F.col("label") % 3 == 0, F.array().cast("array<double>")).when(F.col("label") % 5 == 1, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))
    return v.select("vec_id", V.valid(spoiled).alias("valid"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vectors_missing(spark, sf_dir):
    r = records(spark, sf_dir).where("language = 'en'").withColumn("chunk_id", F.col("source_id"))
    missing = retrieval.missing_vectors(r, _own_vectors(spark, sf_dir).withColumn("model", F.lit("m")), "m")
    return missing.select(F.substring_index("source_id", "_", -1).cast("long").alias("doc_id"))


def _stale_vectors(spark, sf_dir):
    """Embeddings as vectors of the model `m`, of which some were made of an older text and some are another model's."""
    n = F.substring_index("chunk_id", "_", -1).cast("long")
    v = _own_vectors(spark, sf_dir)
    return v.withColumns({"checksum": F.when(n % 9 == 2, "old").otherwise(F.col("checksum")), "model": F.when(n % 5 == 1, "other").otherwise("m"), "vec_id": n})


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND vec_id % 9 <> 2 AND vec_id % 5 <> 1")
def vectors_pruned(spark, sf_dir):
    r = records(spark, sf_dir).where("language = 'en'").withColumn("chunk_id", F.col("source_id"))
    return retrieval.pruned_vectors(_stale_vectors(spark, sf_dir), r, "m").select("vec_id")


@query("SELECT CASE WHEN vec_id % 5 = 1 THEN 'other' ELSE 'm' END AS model, count(*) AS n, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN min(len(embedding)) END AS dimensions FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def vector_status(spark, sf_dir):
    return retrieval.vector_status(_stale_vectors(spark, sf_dir))


@query("SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en FROM documents")
def vectors_replaced(spark, sf_dir):
    """A full replacement: every document has exactly one valid vector of one length, or nothing is replaced."""
    r = records(spark, sf_dir).withColumn("chunk_id", F.col("source_id"))
    whole = retrieval.complete_vectors(r, _all_vectors(spark, sf_dir))
    return whole.join(r.select("chunk_id", "language"), "chunk_id").agg(F.count("*").alias("n"), F.count_if(F.col("language") == "en").alias("n_en"))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def vectors_upsert(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    fresh = v.where("vec_id % 4 = 0").withColumn("label", F.lit(-1))
    return retrieval.vector_upsert(v, fresh, ["vec_id"]).select("vec_id", "label")


_TWO = ("thereat", "ereding")


@query(
    f"""WITH v AS (SELECT DISTINCT unnest({terms_sql('text', config.STOP_WORDS)}) AS token FROM documents WHERE lang = 'en')
    SELECT term, count(*) AS n_tokens, min(token) AS first_token FROM v, (VALUES {", ".join(f"('{t}')" for t in _TWO)}) q(term)
    WHERE token = term OR (length(token) >= 5 AND length(term) >= 5 AND (contains(token, term) OR contains(term, token))) GROUP BY term"""
)
def related_vocabulary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("lang").alias("language"), F.col("doc_id"), "text")
    vocab = index.vocabulary(index.postings(d, "doc_id", {"content": "text"}))
    asked = spark.createDataFrame([("en", t) for t in _TWO], "language string, term string")
    return index.relate(vocab, segments.trigrams(vocab), asked).groupBy("term").agg(F.count("*").alias("n_tokens"), F.min("token").alias("first_token"))


_MANY = {1: "thereation eredon", 2: "ingthe onering", 3: "heation"}


def _many_sql() -> str:
    parts = []
    for k, q in _MANY.items():
        terms = X.query_terms(q)
        unique = list(dict.fromkeys(terms))
        df = ", ".join(f"count(*) FILTER ({_hit('tb', t)} OR {_hit('tt', t)}) AS d{i}" for i, t in enumerate(unique))
        w = ", ".join(f"1 + ln((1 + n)::DOUBLE / (1 + d{i})) AS w{i}" for i in range(len(unique)))
        parts.append(f"SELECT {k} AS question_id, doc_id, lexical FROM (SELECT tok.*, {_relevance_sql(terms, 'tt', 'tb')} AS lexical FROM tok, (SELECT {w} FROM (SELECT count(*) AS n, {df} FROM tok)))")
    tok = f"tok AS (SELECT *, {terms_sql('title', config.STOP_WORDS)} AS tt, {terms_sql('content', config.STOP_WORDS)} AS tb FROM records WHERE language = 'en')"
    return f"""WITH {RECORDS}, {tok}, s AS (SELECT question_id, doc_id, {r6_sql('lexical')} AS score FROM ({' UNION ALL '.join(parts)}) WHERE lexical > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 5"""


@query(_many_sql())
def index_search_many(spark, sf_dir):
    """Many questions through the postings in one job."""
    found = search.lexical_search(stored_index(spark, sf_dir), asked(spark, _MANY))
    rows = found.select("question_id", F.substring_index("source_id", "_", -1).cast("long").alias("doc_id"), r6(F.col("lexical_score")).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query(_many_sql().replace("FROM documents)", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 97 = 5 THEN upper(text) || ' thereation' ELSE text END AS text) FROM documents WHERE doc_id % 89 <> 7))"))
def index_updated_search(spark, sf_dir):
    """Search after a change of some records and the removal of others: a segment more, dead rows, and the results of a rebuilt index."""
    n = F.substring_index("source_id", "_", -1).cast("long")
    old = records(spark, sf_dir)
    new_text = F.when(n % 97 == 5, F.concat(F.upper("content"), F.lit(" thereation"))).otherwise(F.col("content"))
    new = old.where(n % 89 != 7).withColumn("content", new_text).withColumns({"title": F.left("content", F.lit(60)), "checksum": X.checksum(F.col("content"))})
    folder, whole = work_folder(spark), lambda r: r.withColumn("chunk_id", F.col("source_id"))
    segments.update(old, folder, whole)
    segments.update(new, folder, whole)
    found = search.lexical_search(segments.Index.read(spark, folder), asked(spark, _MANY))
    rows = found.select("question_id", F.substring_index("source_id", "_", -1).cast("long").alias("doc_id"), r6(F.col("lexical_score")).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query()
def evaluation_cases(spark, sf_dir):
    """An evaluation suite over the index in one job: retrieval and deterministic cases, of which some expect what isn't there."""
    none = []
    cases = [
        ("case_1", "finds a document", True, "en", QUESTION, "retrieval", "OUT_OF_SCOPE", none, none, None, none, none, ["t"]),
        ("case_2", "expects another source", True, "en", QUESTION, "retrieval", "OUT_OF_SCOPE", none, ["no_such_source"], None, none, none, ["t"]),
        ("case_3", "answers from evidence", True, "en", "thereation eredon", "deterministic", "PRODUCT_INFORMATION", ["fallback"], none, None, none, ["zzzz"], ["t"]),
        ("case_4", "asks for a meeting", True, "en", "I want to book a meeting", "deterministic", "REQUEST_APPOINTMENT", ["deterministic"], none, None, none, none, ["t"]),
        ("case_5", "is off", False, "en", "x y", "deterministic", "OUT_OF_SCOPE", ["fallback"], none, None, none, none, ["t"]),
    ]
    schema = "case_id string, description string, enabled boolean, language string, question string, execution_mode string, expected_intent string, expected_generation array<string>, expected_source_ids array<string>, expected_contact_id string, required_phrases array<string>, forbidden_phrases array<string>, tags array<string>"
    df = spark.createDataFrame(cases, schema)
    made = answers.execute_cases(df, stored_index(spark, sf_dir), records(spark, sf_dir))
    return made.join(answers.case_faults(df), "case_id", "left").select("case_id", "passed", F.array_join("failure_codes", ",").alias("failures"), F.array_join("fallback_codes", ",").alias("fallbacks"), F.size("source_ids").alias("n_sources"), "fault")


@query()
def graph_tool_search(spark, sf_dir):
    """Search with graph scores: documents of the sources that a question's entities lead to come up."""
    d = records(spark, sf_dir).where("language = 'en'").select("source_id", "title")
    edges = d.select(F.substring_index("source_id", "_", -1).cast("long").alias("row"), F.concat(F.lit("Topic "), F.substring_index("source_id", "_", -1)).alias("subject"), F.lit("DOCUMENTED_BY").alias("predicate"), F.col("source_id").alias("object"), "source_id")
    none = spark.createDataFrame([], "entity string, alias string, language string, source_id string")
    first = d.agg(F.min("source_id")).first()[0]
    q = asked(spark, {1: f"about topic {first.split('_')[-1]} and thereation", 2: "eredon"})
    return search.tool_search(stored_index(spark, sf_dir), q, edges, none).select("question_id", "rank", "source_id", "score", "ontology_score")
