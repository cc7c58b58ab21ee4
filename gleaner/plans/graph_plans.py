"""Queries of graphs and of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import config
from gleaner.operators import answers, graph, routing
from gleaner.plans.base import events, query, table

#: Edges from the relational tables: nations belong to regions, suppliers are located in nations.
_EDGES = """edges AS (SELECT n_nationkey + 1 AS row, n_name AS subject, 'BELONGS_TO' AS predicate, r_name AS object, 'src_' || n_regionkey AS source_id FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 100 + s_suppkey, s_name, 'HAS_LOCATION', n_name, 'src_' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_BOTH = "both_ways AS (SELECT subject AS label, object AS neighbour, row FROM edges UNION ALL SELECT object, subject, row FROM edges)"
QUESTION = "Which suppliers of nation_3 or Region_1 are there?"


def _edges(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    a = n.join(r, n.n_regionkey == r.r_regionkey)
    source = F.concat(F.lit("src_"), F.col("n_regionkey").cast("string")).alias("source_id")
    belongs = a.select((F.col("n_nationkey") + 1).cast("long").alias("row"), F.col("n_name").alias("subject"), F.lit("BELONGS_TO").alias("predicate"), F.col("r_name").alias("object"), source)
    located = s.join(n, s.s_nationkey == n.n_nationkey).select((F.col("s_suppkey") + 100).alias("row"), F.col("s_name").alias("subject"), F.lit("HAS_LOCATION").alias("predicate"), F.col("n_name").alias("object"), source)
    return belongs.unionByName(located)


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey = 3").select(F.col("n_name").alias("label"))


_SEED = "(SELECT n_name FROM nation WHERE n_nationkey = 3)"


@query(
    f"""WITH {_EDGES}, l AS (SELECT subject AS label FROM edges UNION SELECT object FROM edges), f AS (SELECT label, array_to_string(regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS f FROM l), q AS (SELECT lower(n_name) || ' and the ' || lower(r_name) || ' there' AS q FROM nation, region WHERE n_nationkey = 3 AND r_regionkey = 1)
    SELECT label FROM f, q WHERE f <> '' AND contains(' ' || array_to_string(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' ', ' ' || f || ' ')"""
)
def graph_seed_match(spark, sf_dir):
    e = _edges(spark, sf_dir)
    labels = e.select(F.explode(F.array("subject", "object")).alias("label")).distinct()
    n, r = table(spark, sf_dir, "nation").where("n_nationkey = 3").first(), table(spark, sf_dir, "region").where("r_regionkey = 1").first()
    return graph.seeds(labels, f"{n.n_name} and the {r.r_name} there")


@query(f"WITH {_EDGES}, {_BOTH} SELECT neighbour, row FROM both_ways WHERE label = {_SEED} AND neighbour <> label")
def graph_hop1(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir), _seeds(spark, sf_dir)).select("neighbour", "row")


@query(
    f"""WITH {_EDGES}, {_BOTH}, one AS (SELECT label, neighbour, row FROM both_ways WHERE label = {_SEED} AND neighbour <> label)
    SELECT 1 AS depth, label || '>' || neighbour AS path, row::VARCHAR AS rows FROM one
    UNION ALL SELECT 2, o.label || '>' || o.neighbour || '>' || b.neighbour, o.row || ',' || b.row FROM one o JOIN both_ways b ON b.label = o.neighbour WHERE b.neighbour NOT IN (o.label, o.neighbour)"""
)
def graph_hop2(spark, sf_dir):
    p = graph.paths(_edges(spark, sf_dir), _seeds(spark, sf_dir), 2)
    return p.select("depth", F.array_join("entities", ">").alias("path"), F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query("SELECT url AS canonical_url, max(CASE WHEN page_id % 3 = 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS score FROM pages GROUP BY url")
def url_max_score(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select(F.col("url").alias("canonical_url"), F.when(F.col("page_id") % 3 == 0, config.DEPTH_SCORES[1]).otherwise(config.DEPTH_SCORES[2]).alias("score"))
    return graph.max_scores(s)


@query("SELECT entity_id, CASE WHEN count(*) OVER (PARTITION BY label) = 1 THEN label ELSE label || ' [' || right(entity_id, 8) || ']' END AS name FROM (SELECT 'entity_' || lpad(p_partkey::VARCHAR, 10, '0') AS entity_id, p_name AS label FROM part)")
def label_disambiguation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("entity_"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("entity_id"), F.col("p_name").alias("label"))
    return graph.disambiguated(p).select("entity_id", "name")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS occurrence FROM part")
def occurrence_index(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")) - 1).cast("long").alias("occurrence"))


@query(f"WITH {_EDGES}, {_BOTH} SELECT label, array_to_string(list_sort(list(row)), ',') AS rows FROM both_ways GROUP BY label")
def entity_rows(spark, sf_dir):
    return graph.entity_rows(_edges(spark, sf_dir)).select("label", F.array_join(F.col("relationship_rows").cast("array<string>"), ",").alias("rows"))


@query(
    f"""WITH {_EDGES}, x AS (SELECT row, CASE WHEN row % 7 = 0 THEN 'LIKES' ELSE predicate END AS predicate, CASE WHEN row % 5 = 0 THEN '<b>' ELSE subject END AS subject, object, CASE WHEN row % 3 = 0 THEN 'src_x' ELSE source_id END AS source_id FROM edges),
    y AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object, source_id ORDER BY row) > 1 AS twice FROM x)
    SELECT row, array_to_string(list_filter([CASE WHEN twice THEN 'duplicate_relationship' END, CASE WHEN predicate = 'LIKES' THEN 'unsupported_predicate' END, CASE WHEN subject = '<b>' THEN 'unsafe_text' END, CASE WHEN source_id = 'src_x' THEN 'unknown_source' END], lambda i: i IS NOT NULL), ',') AS issues FROM y"""
)
def graph_issue_lists(spark, sf_dir):
    e = _edges(spark, sf_dir)
    n = F.col("row")
    spoiled = e.select(
        "row",
        F.when(n % 5 == 0, "<b>").otherwise(F.col("subject")).alias("subject"),
        F.when(n % 7 == 0, "LIKES").otherwise(F.col("predicate")).alias("predicate"),
        "object",
        F.when(n % 3 == 0, "src_x").otherwise(F.col("source_id")).alias("source_id"),
    )
    return graph.issues(spoiled, e.select("source_id").distinct()).select("row", F.array_join("issues", ",").alias("issues"))


@query(
    """WITH i AS (SELECT doc_id, quality, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'f' || doc_id END AS fingerprint FROM labels), r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'suppressed' ELSE 'reset' END AS decision, doc_id % 9 AS revision, 'f' || doc_id AS f FROM labels WHERE doc_id % 3 <> 0)
    SELECT i.doc_id, CASE WHEN decision IS NULL OR decision = 'reset' THEN 'automated' WHEN f = fingerprint THEN decision ELSE 'needs_review' END AS status, coalesce(revision, 0) AS revision FROM i LEFT JOIN r USING (doc_id)"""
)
def review_status(spark, sf_dir):
    d = F.col("doc_id")
    own = F.concat(F.lit("f"), d.cast("string"))
    items = table(spark, sf_dir, "labels").select("doc_id", F.when(d % 5 == 0, "changed").otherwise(own).alias("fingerprint"))
    reviews = table(spark, sf_dir, "labels").where("doc_id % 3 <> 0").select("doc_id", F.when(d % 4 == 0, "approved").when(d % 4 == 1, "suppressed").otherwise("reset").alias("decision"), (d % 9).alias("revision"), own.alias("fingerprint"))
    return graph.reviewed(items, reviews, "doc_id").select("doc_id", "status", "revision")


@query("SELECT l_orderkey, bool_and(l_partkey % 5 <> 0 OR l_linenumber > 3) AS all_found FROM lineitem GROUP BY l_orderkey")
def expected_subset(spark, sf_dir):
    """Whether the expected ids of each case are all among the actual ones, of which some are left out."""
    wanted = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_partkey", "l_linenumber")
    return answers.expected_found(wanted.select("l_orderkey", "id"), wanted.where("l_partkey % 5 <> 0 OR l_linenumber > 3"), "l_orderkey", "id")


@query(
    """WITH a AS (SELECT c_custkey AS row, c_name AS entity, CASE WHEN c_custkey % 4 = 0 THEN 'shared' ELSE 'alias ' || c_custkey END AS alias, CASE WHEN c_custkey % 9 = 0 THEN 'fr' ELSE 'en' END AS language, CASE WHEN c_custkey % 5 = 0 THEN 'lost' ELSE 's1' END AS source_id FROM customer)
    SELECT row, array_to_string(list_filter([CASE WHEN alias = 'shared' AND (SELECT count(*) FROM a b WHERE b.alias = 'shared' AND b.language = a.language) > 1 THEN 'ambiguous_alias' END, CASE WHEN language = 'fr' THEN 'unsupported_language' END, CASE WHEN row % 6 = 0 THEN 'unknown_entity' END, CASE WHEN source_id = 'lost' THEN 'unknown_source' END], lambda i: i IS NOT NULL), ',') AS issues FROM a"""
)
def alias_issue_lists(spark, sf_dir):
    n = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    a = c.select(n.alias("row"), F.col("c_name").alias("entity"), F.when(n % 4 == 0, "shared").otherwise(F.concat(F.lit("alias "), n.cast("string"))).alias("alias"), F.when(n % 9 == 0, "fr").otherwise("en").alias("language"), F.when(n % 5 == 0, "lost").otherwise("s1").alias("source_id"))
    known = c.where("c_custkey % 6 <> 0").select(F.col("c_name").alias("subject"), F.lit("thing").alias("object"))
    return graph.alias_issues(a, known, spark.createDataFrame([("s1",)], "source_id string")).select("row", F.array_join("issues", ",").alias("issues"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 <> 0 THEN 'shown ' || p_partkey ELSE p_name END AS display_label FROM part")
def display_labels(spark, sf_dir):
    """Approved labels show, unless the entity changed since."""
    n = F.col("p_partkey")
    e = table(spark, sf_dir, "part").select(n.alias("entity_id"), F.col("p_name").alias("label"), F.when(n % 7 == 0, "new").otherwise("f").alias("fingerprint"))
    r = e.where("entity_id % 3 = 0").select("entity_id", F.lit("approved").alias("decision"), F.lit("f").alias("fingerprint"), F.concat(F.lit("shown "), F.col("entity_id").cast("string")).alias("display_label"))
    return graph.display_labels(e, r).select(F.col("entity_id").alias("p_partkey"), "display_label")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 4 <> 0 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) AS effective FROM lineitem")
def parents_excluded(spark, sf_dir):
    """Items that lean on excluded entities are out, whatever their own review says."""
    i = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("item"), "l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4 != 0).alias("effective"), F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("parent_ids"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item_id"), (F.col("p_size") <= 40).alias("effective"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("item_id"), (F.col("s_nationkey") != 3).alias("effective"))
    return graph.with_parents(i, parts.union(suppliers)).select("l_orderkey", "l_linenumber", "effective")


@query()
def graph_walk(spark, sf_dir):
    """Bounded searches of many questions over the edges of nations, regions and suppliers."""
    none = spark.createDataFrame([], "entity string, alias string, language string, source_id string")
    n = table(spark, sf_dir, "nation")
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("which suppliers has "), "n_name").alias("text"), F.lit("en").alias("language"))
    found = graph.graph_search(_edges(spark, sf_dir), none, asked, 2)
    return found.select("query_id", F.array_join("matched", ",").alias("matched"), F.size("paths").alias("n_paths"), F.size("expanded").alias("n_expanded"), F.size("scores").alias("n_scores"), "truncated")


@query("SELECT contact_id FROM (SELECT s_suppkey AS contact_id, s_nationkey FROM supplier) WHERE contact_id % 2 = 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def contacts_unsourced(spark, sf_dir):
    """Active contacts whose source no active record backs."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contact_id"), (F.col("s_suppkey") % 2 == 0).alias("active"), F.col("s_nationkey").alias("official_source_url"))
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("canonical_url"), F.when(F.col("n_regionkey") != 1, "active").otherwise("archived").alias("source_status"))
    return routing.contacts_without_source(c, r).select("contact_id")


@query(
    """SELECT suite, count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, sum(toxic)::BIGINT AS model_calls,
    coalesce(array_to_string((SELECT list(c ORDER BY f) FROM (SELECT c, min(doc_id) AS f FROM (SELECT doc_id, CASE WHEN quality = 0 THEN 'code_' || doc_id % 11 END AS c FROM labels l2 WHERE l2.doc_id % 10 = l.suite) WHERE c IS NOT NULL GROUP BY c))[1:8], ','), '') AS codes
    FROM (SELECT doc_id % 10 AS suite, * FROM labels) l GROUP BY suite"""
)
def suite_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 10).alias("suite"),
        "doc_id",
        (F.col("quality") == 1).alias("passed"),
        F.col("toxic").cast("long").alias("model_calls"),
        F.when(F.col("quality") == 0, F.array(F.concat(F.lit("code_"), (F.col("doc_id") % 11).cast("string")))).otherwise(F.array().cast("array<string>")).alias("codes"),
    )
    return answers.suite_summary(r, ["suite"], "doc_id").withColumn("codes", F.array_join("codes", ","))


@query(
    """SELECT event_id, array_to_string(list_filter([CASE event_id % 4 WHEN 1 THEN 'provider_unavailable' WHEN 2 THEN 'grounding_rejected' END, CASE WHEN event_type <> 'click' THEN 'intent_mismatch' END,
      CASE WHEN value < 50 AND event_id % 4 NOT IN (1, 2) THEN 'generation_mismatch' END, CASE WHEN user_id % 2 = 0 THEN 'source_mismatch' END, CASE WHEN NOT contains(props, '1') THEN 'required_phrase_missing' END,
      CASE WHEN contains(props, '7') THEN 'forbidden_phrase_present' END], lambda c: c IS NOT NULL), '|') AS codes FROM events"""
)
def failure_codes(spark, sf_dir):
    """Cases observed in the event log, from checks to their failure codes."""
    n = F.col("event_id") % 4
    empty = F.array().cast("array<string>")
    observed = events(spark, sf_dir).select(
        "event_id", F.lit("full").alias("execution_mode"), F.col("event_type").alias("intent"), F.lit("click").alias("expected_intent"), F.when(F.col("value") < 50, "fallback").otherwise("ok").alias("generation"), F.array(F.lit("ok")).alias("expected_generation"),
        F.array(F.lit("a")).alias("expected_source_ids"), F.when(F.col("user_id") % 2 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("c"))).alias("source_ids"), F.lit(None).cast("string").alias("expected_contact_id"), F.lit(None).cast("string").alias("contact_id"),
        F.col("props").alias("answer"), F.array(F.lit("1")).alias("required_phrases"), F.array(F.lit("7")).alias("forbidden_phrases"),
        F.when(n == 1, F.array(F.lit("provider_unavailable"))).when(n == 2, F.array(F.lit("missing_citation"))).otherwise(empty).alias("fallbacks"),
    )
    return answers.case_checks(observed).select("event_id", F.array_join(answers.failure_codes(F.col("checks"), F.col("fallbacks")), "|").alias("codes"))
