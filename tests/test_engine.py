"""Graphs, answers, search settings, versions and logs on small fixtures with known results."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import digests
from gleaner.functions import text as X
from gleaner.operators import admission, answers, conversations, duplicates, graph, index, logs, records as R, retrieval, routing, search, versions

CONTENT = "\n\n".join(
    ["Company: Nordic Pumps (NP)", "Nordic Pumps provides River Pump.", "Nordic Pumps does not provide Repair.", "Product: River Pump", "River Pump belongs to Water", "Category: Water", "Location: Kiruna", "Nordic Pumps is located in Kiruna.", "History"]
)
HEADS = ["Company: Nordic Pumps (NP)", "Product: River Pump", "Category: Water", "Location: Kiruna", "History"]


def source(spark, content=CONTENT, heads=HEADS):
    sections = [("section", h, content.index(h), content.index(h) + len(h)) for h in heads]
    row = ("s1", "https://a.org/p", "en", content, sections)
    return spark.createDataFrame([row], "source_id string, canonical_url string, language string, content string, sections array<struct<kind:string,label:string,start:int,end:int>>").withColumn("checksum", X.checksum(F.col("content")))


@pytest.fixture(scope="module")
def built(spark):
    return source(spark).cache(), {k: v.cache() for k, v in graph.build_graph(source(spark)).items()}


def test_graph_build(built):
    records, g = built
    assert {(r.type, r.label) for r in g["entities"].collect()} == {("organization", "Nordic Pumps"), ("product", "River Pump"), ("category", "Water"), ("location", "Kiruna"), ("topic", "History")}
    names = {r.entity_id: r.label for r in g["entities"].collect()}
    edges = {(names[r.subject_id], r.predicate, names.get(r.object_id, r.object_id)) for r in g["relationships"].collect() if r.predicate != "DOCUMENTED_BY"}
    assert edges == {("Nordic Pumps", "PROVIDES", "River Pump"), ("River Pump", "BELONGS_TO", "Water"), ("Nordic Pumps", "HAS_LOCATION", "Kiruna")}
    assert [r.label for r in g["aliases"].collect()] == ["NP"]
    text = records.first().content
    assert all(text[r.start : r.end] == r.quote for r in g["evidence"].collect())
    assert graph.graph_violations(g, records).count() == 0


def test_graph_tampering(spark, built):
    records, g = built
    worse = [
        g | {"entities": g["entities"].withColumn("label", F.lit("Another"))},
        g | {"evidence": g["evidence"].withColumn("start", F.col("start") + 1)},
        g | {"relationships": g["relationships"].withColumn("predicate", F.lit("PROVIDES"))},
        g | {"aliases": g["aliases"].withColumn("label", F.lit("XX"))},
        g | {"entities": g["entities"].union(g["entities"])},
        g | {"evidence": g["evidence"].where("kind <> 'statement'")},
    ]
    assert all(graph.graph_violations(w, records).count() > 0 for w in worse)
    assert graph.graph_violations(g, records.withColumn("checksum", F.lit("other"))).count() > 0


def test_ambiguous_labels_make_no_edges(spark):
    heads = ["Company: Twin", "Product: Twin", "Product: Sole"]
    g = graph.build_graph(source(spark, "\n\n".join([*heads, "Twin provides Sole"]), heads))
    assert g["entities"].count() == 3 and g["relationships"].where("predicate = 'PROVIDES'").count() == 0


def test_caps(spark):
    heads = [f"Topic number {i:02d}" for i in range(45)]
    rows = source(spark, "\n\n".join(heads), heads)
    g = graph.build_graph(rows, graph.SITE_CAPS)
    assert g["entities"].count() == 40 and g["report"].first().truncated
    whole = graph.build_graph(rows)
    assert whole["entities"].count() == 45 and not whole["report"].first().truncated
    for caps in ({"entities": 3}, {"edges": 3}):
        g = graph.build_graph(rows, caps)
        assert g["report"].first().truncated and g["relationships"].count() == 3


def test_label_graph_and_search(spark, built):
    records, g = built
    edges, aliases = graph.label_graph(g)
    rows = edges.orderBy("subject", "predicate").withColumn("row", F.monotonically_increasing_id() + 1)
    rows = spark.createDataFrame([(k, r.subject, r.predicate, r.object, r.source_id) for k, r in enumerate(rows.collect(), 1)], "row long, subject string, predicate string, object string, source_id string")
    assert graph.issues(rows, records.select("source_id")).where(F.size("issues") > 0).count() == 0
    asked = spark.createDataFrame([(1, "What does NP offer?", "en"), (2, "nothing here", "en"), (3, "NP", "sv"), (4, "about kiruna", "en")], "query_id int, text string, language string")
    urls = records.select("source_id", "canonical_url", "language")
    got = {r.query_id: (r.source_id, r.ontology_score) for r in graph.bounded_search(rows, aliases, asked, urls, 2).collect()}
    assert got == {1: ("s1", 0.6), 4: ("s1", 0.6)}


def test_bounded_search_caps(spark):
    edges = spark.createDataFrame([(i, "Hub", "INCLUDES", f"Leaf {i:02d}", "s1") for i in range(1, 13)], "row long, subject string, predicate string, object string, source_id string")
    none = spark.createDataFrame([], "entity string, alias string, language string, source_id string")
    urls = spark.createDataFrame([("s1", "u", "en")], "source_id string, canonical_url string, language string")
    asked = spark.createDataFrame([(1, "the hub", "en")], "query_id int, text string, language string")
    r = graph.bounded_search(edges, none, asked, urls, 1).first()
    assert (r.n_paths, r.truncated) == (config.MAX_BRANCHES, True)


def plain_walk(edges, found, depth):
    """The bounded breadth-first search, as a loop: (paths as rows, expanded, truncated)."""
    at = {}
    for row, subject, _, obj, _ in edges:
        at.setdefault(subject, []).append((row, obj))
        at.setdefault(obj, []).append((row, subject))
    order = sorted(found)[:8]
    cut, seen, walked = len(found) > 8, list(order), []
    for seed in order:
        queue = [((seed,), ())]
        while queue and len(walked) < 32:
            entities, rows = queue.pop(0)
            if len(rows) >= depth:
                continue
            near = sorted(at.get(entities[-1], []))
            cut = cut or len(near) > 8
            for row, other in near[:8]:
                if other in entities:
                    continue
                if len(walked) >= 32:
                    cut = True
                    break
                if other not in seen and len(seen) >= 60:
                    cut = True
                    continue
                if (*rows, row) not in walked:
                    walked.append((*rows, row))
                if other not in seen:
                    seen.append(other)
                    queue.append(((*entities, other), (*rows, row)))
    return walked, seen[len(order) :], cut or len(walked) >= 32


def test_graph_search_order(spark):
    """Joins and one fold against the loop, on random graphs with hubs, cycles and more than the bounds allow."""
    import random

    rng = random.Random(4)
    for trial, (nodes, n) in enumerate(((8, 14), (60, 150))):
        edges = []
        for i in range(1, n + 1):
            a, b = rng.sample(range(nodes), 2)
            edges.append((i, f"node n{a:02d}", "INCLUDES", f"node n{b if rng.random() < 0.7 else 0:02d}", f"s{i % 7}"))
        edges = [e for e in edges if e[1] != e[3]]
        df = spark.createDataFrame(edges, "row long, subject string, predicate string, object string, source_id string")
        none = spark.createDataFrame([], "entity string, alias string, language string, source_id string")
        known = {x for e in edges for x in (e[1], e[3])}
        texts = [" and ".join(rng.sample(sorted(known), min(k, len(known)))) for k in (1, 2, 5, 12)]
        asked = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "query_id int, text string, language string")
        for depth in (1, 2):
            got = {r.query_id: r for r in graph.graph_search(df, none, asked, depth).collect()}
            for i, t in enumerate(texts):
                found = {k for k in known if f" {k} " in f" {t} "}
                walked, expanded, cut = plain_walk(edges, found, depth)
                r = got[i]
                assert (sorted(r.matched), [tuple(p.rows) for p in r.paths], r.expanded, r.truncated) == (sorted(found), walked, expanded, cut), (trial, depth, i)


def test_reviews(spark, built):
    _, g = built
    ids = {r.label: r.entity_id for r in g["entities"].collect()}
    items = g["entities"].select("entity_id", F.lit("f").alias("fingerprint"))
    reviews = spark.createDataFrame([(ids["River Pump"], "suppressed", "f", 2), (ids["Water"], "approved", "old", 1), (ids["Kiruna"], "approved", "f", 1)], "entity_id string, decision string, fingerprint string, revision int")
    status = graph.reviewed(items, reviews, "entity_id")
    assert {r.entity_id: r.status for r in status.collect()} == {i: {"River Pump": "suppressed", "Water": "needs_review", "Kiruna": "approved"}.get(n, "automated") for n, i in ids.items()}
    nothing = spark.createDataFrame([], "item_id string, effective boolean")
    left = graph.effective_graph(g, status, nothing)
    assert left["relationships"].where("predicate IN ('PROVIDES', 'BELONGS_TO')").count() == 0 and left["entities"].count() == 3


CORPUS = [
    ("a", "Pumps", "https://x.org/a", "en", "River pumps are machines for water. We sell pumps."),
    ("b", "Terms", "https://x.org/b", "en", "These are the terms. Pumps are mentioned once among other words that matter little."),
    ("c", "Pumps", "https://x.org/c", "en", "Pumps. Content coming soon."),
    ("d", "Pumpar", "https://x.org/d", "sv", "Pumpar är maskiner för vatten."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(CORPUS, "source_id string, title string, canonical_url string, language string, content string")
    return rows.withColumns({"chunk_id": F.col("source_id"), "category": F.lit("information")})


def test_search_ranks_and_filters(corpus):
    got = retrieval.hybrid_search(corpus, corpus, "What are river pumps?", "en").collect()
    assert [r.source_id for r in got][0] == "a" and all(r.language == "en" for r in got)
    about = {r.source_id: (r.score, r.page_quality_factor) for r in retrieval.hybrid_search(corpus, corpus, "pumps", "en").collect()}
    assert about["c"] == (0.45, 0.45) and about["a"][0] > about["b"][0] > about["c"][0]
    assert retrieval.hybrid_search(corpus, corpus, "volcano lava", "en").count() == 0
    assert retrieval.hybrid_search(corpus, corpus, "what is the", "en").count() == 0


def test_semantic_all_or_nothing(spark, corpus):
    v = lambda rows: spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    good = v([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])])
    got = retrieval.hybrid_search(corpus, corpus, "river pumps", "en", vectors=good, query_vector=[0.0, 1.0]).collect()
    assert {r.search_mode for r in got} == {"hybrid"} and {r.source_id: r.semantic_score for r in got}["b"] == 1.0
    for bad in (v([("a", [1.0, 0.0]), ("b", [0.0, 1.0])]), v([("a", [1.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])]), v([("a", [0.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])])):
        got = retrieval.hybrid_search(corpus, corpus, "river pumps", "en", vectors=bad, query_vector=[0.0, 1.0]).collect()
        assert {(r.search_mode, r.fallback_reason, r.semantic_score) for r in got} == {("lexical", "embedding_unavailable", 0.0)}


def test_graph_scores_raise(spark, corpus):
    scores = spark.createDataFrame([("b", 0.6)], "source_id string, ontology_score double")
    got = {r.source_id: r.score for r in retrieval.hybrid_search(corpus, corpus, "river machines", "en", graph_scores=scores).collect()}
    assert got["b"] == 0.6


def test_pieces():
    assert index.pieces("a\n\nb") == ["a\n\nb"]
    long = ("word " * 400).strip()
    assert all(len(p) <= 1500 for p in index.pieces(long)) and " ".join(index.pieces(long)) == long
    assert [len(p) for p in index.pieces("x" * 3200)] == [1500, 1500, 200]
    assert index.pieces("y" * 1400 + "\n\n" + "z" * 200) == ["y" * 1400, "z" * 200]


def test_chunks_of_sections(spark):
    rows = source(spark).drop("checksum").withColumn("content", F.concat(F.lit("åäö "), "content"))
    got = index.chunks(rows, "sections").collect()
    assert [r.chunk_id for r in got] == [f"s1--00{i}" for i in range(1, 6)] and got[1].source_location.label == "Product: River Pump"


def verdict(spark, answer, extractive=True):
    rows = spark.createDataFrame([(1, answer, [tuple(e.values()) for e in EVIDENCE], None)], "answer_id int, answer string, evidence array<struct<source_id:string,content:string>>, names array<string>")
    return answers.checked(rows, extractive).first()


EVIDENCE = [{"source_id": "s1", "content": "Pumps move water. They need 12 volts of power."}]


def test_answer_checks(spark):
    cases = [
        ("Pumps move water. [s1]", True, []),
        ("Pumps move water. [s1] They need 12 volts of power. [s1]", True, []),
        ("Pumps move water.", False, ["missing_citation"]),
        ("Pumps move water. [s2]", False, ["unknown_citation", "missing_citation"]),
        ("[s1] Pumps move water.", False, ["missing_claim", "missing_citation"]),
        ("Pumps move oil. [s1]", False, ["unsupported_claim", "missing_citation"]),
        ("See https://x.org [s1]", False, ["unsafe_format"]),
        ("Book a visit. [s1]", False, ["tool_or_safety_claim"]),
        ("", False, ["invalid_answer"]),
    ]
    rows = [(i, answer, [tuple(e.values()) for e in EVIDENCE], None) for i, (answer, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "answer_id int, answer string, evidence array<struct<source_id:string,content:string>>, names array<string>")
    got = {r.answer_id: (r.accepted, r.reasons) for r in answers.checked(df).collect()}
    assert got == {i: (accepted, reasons) for i, (_, accepted, reasons) in enumerate(cases)}


def test_answer_numbers(spark):
    assert verdict(spark, "They need 13 volts [s1]", extractive=False).reasons == ["unsupported_number", "missing_citation"]
    assert verdict(spark, "They need 12 volts [s1]", extractive=False).cited == ["s1"]
    rows = spark.createDataFrame([(1, "Pumps move water. [s1]", [("s1", "Pumps move water.")], ["Ann"])], "answer_id int, answer string, evidence array<struct<source_id:string,content:string>>, names array<string>")
    r = answers.checked(rows).first()
    assert r.accepted and r.cited == ["s1"]


def test_summary(spark):
    content = "Pumps\nRiver pumps are machines that move water. However, they need power. Unrelated words about hats stand here."
    rows = spark.createDataFrame([(1, 1, "s1", content), (2, 1, "s2", "Det är en text som vi har och att."), (2, 2, "s3", "Hats are soft. Hats keep heads warm in winter days."), (4, 1, "s1", "The words of our page are for you and with us.")], "question_id int, rank int, source_id string, content string")
    asked = spark.createDataFrame([(1, "What are river pumps?", "en", False), (2, "hats", "en", True), (3, "x", "en", False), (4, "What are river pumps?", "sv", False)], "question_id int, text string, language string, cautious boolean")
    got = {r.question_id: r for r in answers.summaries(rows, asked).collect()}
    assert got[1].status == "GROUNDED" and "machines that move water. However, they need power." in got[1].answer and got[1].source_ids == ["s1"]
    assert got[2].source_ids == ["s3"] and got[2].answer.endswith(answers.CAUTION["en"])
    assert [(got[i].status, got[i].source_ids) for i in (3, 4)] == [("UNAVAILABLE", [])] * 2 and got[4].answer == answers.NOT_FOUND["sv"]


FIELDS = "source_id string, title string, canonical_url string, category string, language string, content string"


def test_evidence_messages(spark):
    registry = spark.createDataFrame([(f"s{i}", "t", f"https://x.org/{i % 3}", "c", "en", "c" * 50 + str(i), "active") for i in range(1, 7)], FIELDS + ", source_status string")
    rows = registry.select(F.lit(1).alias("question_id"), F.substring("source_id", 2, 1).cast("int").alias("rank"), *registry.columns[:-1])
    asked = lambda **kw: spark.createDataFrame([tuple(({"question_id": 1, "text": "q", "language": "en", "topic": None} | kw).values())], "question_id int, text string, language string, topic string")
    r = answers.evidence_messages(rows, asked(), registry).first()
    assert r.fault is None and [e.source_id for e in r.evidence] == ["s1", "s2", "s3"] and r.payload.count("source_id") == 3
    assert answers.evidence_messages(rows, asked(topic="Pumps"), registry).first().payload.count("context_topic") == 1
    for kw, fault in (({"topic": "<b>"}, "invalid_evidence"), ({"topic": "the system prompt"}, "invalid_evidence"), ({"language": "sv"}, "invalid_evidence"), ({"question_id": 9}, "no_evidence"), ({"text": "x" * 501}, "invalid_question")):
        assert answers.evidence_messages(rows, asked(**kw), registry).first().fault == fault
    assert answers.evidence_messages(rows, asked(), registry, characters=90).first().fault == "invalid_evidence"
    assert answers.evidence_messages(rows.withColumn("title", F.lit("other")), asked(), registry).first().fault == "invalid_evidence"
    chunks = spark.createDataFrame([("s1", "x", "s1--002", ("page", "2")), ("s1", "x", "s1--001", ("page", "1"))], "source_id string, content string, chunk_id string, source_location struct<kind:string,label:string>")
    assert answers.located(chunks.select("source_id", "content").distinct(), chunks).first().source_location.label == "1"


def test_checked_answers(spark):
    registry = spark.createDataFrame([("s1", "t", "https://x.org/1", "c", "en", "Pumps move water. They need 12 volts of power.", "active")], FIELDS + ", source_status string")
    drafts = {1: "Pumps move water. [s1]", 2: "Water is moved by pumps [s1]", 3: "Pumps need 13 volts. [s1]", 4: None, 5: "Det är en text som vi har och att [s1]", 6: "Pumps move water. [s1]", 7: "Water is moved by pumps [s1]"}
    asked = spark.createDataFrame([(i, "Is this safe?" if i == 6 else "What do pumps do?", "en", None) for i in range(1, 9)], "question_id int, text string, language string, topic string")
    rows = asked.where("question_id < 8").select("question_id").crossJoin(registry.drop("source_status")).withColumns({"rank": F.lit(1), "score": F.lit(0.9)})
    made = answers.checked_answers(asked, rows, registry, spark.createDataFrame(list(drafts.items()), "question_id int, draft string"), spark.createDataFrame([(2, True)], "question_id int, supported boolean"))
    got = {r.question_id: r for r in made.collect()}
    assert (got[1].status, got[1].answer, got[1].source_ids) == ("CHECKED_EXTRACTIVE", "Pumps move water.", ["s1"]) and got[2].status == "CHECKED_PARAPHRASE"
    assert {i: got[i].reasons[0] for i in range(3, 9)} == {3: "unsupported_number", 4: "provider_unavailable", 5: "language_mismatch", 6: "safety_sensitive_question", 7: "semantic_check_failed", 8: "no_evidence"}
    assert got[4].answer.startswith("Pumps move water.") and got[8].status == "UNAVAILABLE" and got[6].answer.endswith(answers.CAUTION["en"])


def test_routing(spark):
    said = spark.createDataFrame([(1, "I need C++ help"), (2, "a catalog"), (3, "buy a cat"), (4, "a cat")], "id int, text string")
    rules = (("late", "second", 20, "all", ("cat", "c++")), ("early", "first", 10, "en", ("cat",)))
    got = {r.id: r.intent for r in routing.route_phrases(said, rules).collect()}
    assert got == {1: "second", 2: "information", 3: "action_unavailable", 4: "second"}
    got = {r.id: r.intent for r in routing.route_phrases(said, rules, language=F.lit("en")).collect()}
    assert got[4] == "first"
    for bad in ("(?=a)", r"(a)\1", "(a+)+"):
        with pytest.raises(ValueError):
            routing.check_pattern(bad)


def test_contacts(spark):
    contacts = spark.createDataFrame(
        [("k1", True, 1, ["norway"], ["pump"], []), ("k2", True, 5, ["sweden"], ["pump"], ["repair"]), ("k3", True, 5, ["sweden"], ["pump"], ["repair"]), ("k4", False, 9, ["sweden"], ["pump"], ["repair"])],
        "contact_id string, active boolean, priority int, geographic_regions array<string>, product_categories array<string>, service_categories array<string>",
    )
    needs = spark.createDataFrame([(1, "Repair my PUMP", None), (2, "a hat", None)], "need_id int, need string, region string")
    got = {r.need_id: r for r in routing.find_contact(needs, contacts, {"pump": ("pump",), "repair": ("repair", "fix")}).collect()}
    assert (got[1].contact_id, got[1].alternative_id, got[1].ambiguous) == ("k2", "k3", True) and got[2].reason == "no_exact_route"


def test_language():
    assert digests.label_form("Straße  CAFÉ-bar") == "strasse café bar" and digests.claim_form(" “Yes, it IS.” ") == "yes, it is"


@pytest.mark.parametrize("text, language, want", [("Det är en text som vi har och att", "en", True), ("The plain words of our page are here.", "en", False), ("The words are ours. Det är och med som text.", "en", True), ("och_med som-att https://och.det/med", "en", False), ("Kort text", "sv", False)])
def test_language_mismatch(spark, text, language, want):
    assert spark.range(1).select(X.language_mismatch(F.lit(text), language).alias("m")).first().m == want


def test_record_reasons(spark):
    good = {"source_id": "s1", "title": "t", "canonical_url": "https://x.org/a", "category": "c", "language": "en", "retrieved_at": "2026", "source_status": "active", "content": "words"}
    cases = [({}, None), ({"source_id": "a b"}, "invalid_source_id"), ({"title": None}, "missing_metadata"), ({"category": " "}, "blank_metadata"), ({"canonical_url": "http://localhost/x"}, "invalid_url"), ({"language": "fr"}, "unsupported_language"), ({"source_status": "x"}, "invalid_status"), ({"content": "a jailbreak"}, "instruction_like_content")]
    rows = [tuple((good | c)[k] for k in good) for c, _ in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in good)).withColumn("checksum", X.checksum(F.col("content")))
    assert [r.reason for r in R.validated(df).collect()] == [w for _, w in cases]
    assert R.validated(df.limit(1).withColumn("checksum", F.lit("no"))).first().reason == "checksum_mismatch"


HOME = "https://x.org/"


def ids(spark, names):
    return spark.createDataFrame([(i,) for i in names], "source_id string")


def test_versions(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "store"))
    rows = lambda names: ids(spark, names)
    one = store.stage({"records": rows("abcde")}, HOME)
    assert store.status()["version"] is None
    assert store.activate(one, 0)["revision"] == 1
    with pytest.raises(versions.Conflict):
        store.activate(one, 0)
    few = store.stage({"records": rows("ab")}, HOME)
    with pytest.raises(versions.Conflict, match="coverage"):
        store.activate(few, 1)
    assert store.completed(few)["state"] == "review_required" and store.completed(few, automatic=False)["state"] == "staged"
    assert store.activate(few, 1, allow_drop=True)["version"] == few
    elsewhere = store.stage({"records": rows("ab")}, "https://y.org/")
    with pytest.raises(versions.Conflict, match="site"):
        store.activate(elsewhere, 2)
    with pytest.raises(versions.Conflict, match="no records"):
        store.activate(store.stage({"records": rows("")}, HOME), 2)
    with pytest.raises(versions.Conflict, match="faults"):
        store.restore(one, 2, check=lambda d: ["a fault"])
    assert store.restore(one, 2)["version"] == one and store.active()["records"].count() == 5
    listed = {r.version: r.revision for r in store.listing().collect()}
    assert listed[one] == 3 and listed[few] == 2 and listed[elsewhere] is None
    assert store.completed(store.stage({"records": rows("abcdef")}, HOME))["state"] == "active"
    last = store.status()
    spark.createDataFrame([("z",)], "source_id string").write.mode("append").parquet(f"{tmp_path}/store/{last['version']}/records")
    with pytest.raises(versions.Conflict, match="not as it was"):
        store.active()
    assert [h["operation"] for h in last["history"]] == ["activate", "activate", "restore", "activate"]


def test_two_writers(spark, tmp_path):
    """Of two writers of one revision the second fails, and a reader sees a whole revision at any time."""
    a, b = (versions.Versions(spark, str(tmp_path / "store")) for _ in range(2))
    one = a.stage({"records": ids(spark, "ab")}, HOME)
    a.activate(one, 0)
    entry = {"revision": 2, "version": one, "operation": "activate", "at": 0.0}
    a._create("revision-2.json", entry)
    with pytest.raises(versions.Conflict, match="there already"):
        b._create("revision-2.json", entry)
    assert b.status()["revision"] == 2


def test_governed_change_and_backup(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "store"))
    registry = spark.createDataFrame([(f"s{i}", f"https://x.org/{i}", "en", "active") for i in range(4)], "source_id string, canonical_url string, language string, source_status string")
    store.activate(store.stage({"records": registry, "rules": spark.createDataFrame([("r1", "A", 10, "all", "a+")], routing.RULE_SCHEMA)}, HOME), 0)
    seen = versions.content_digest(store.active()["records"])
    change = spark.createDataFrame([("archive", "s1", "", "", ""), ("add", "s9", "https://x.org/9", "en", "")], "operation string, source_id string, canonical_url string, language string, source_status string")
    edit = lambda df: versions.edited_registry(df, change)[0]
    assert store.change("records", seen, edit, versions.registry_faults)["revision"] == 2
    now = {r.source_id: r.source_status for r in store.active()["records"].collect()}
    assert now == {"s0": "active", "s1": "archived", "s2": "active", "s3": "active", "s9": "active"}
    with pytest.raises(versions.Conflict, match="meanwhile"):
        store.change("records", seen, edit, versions.registry_faults)
    digest = versions.content_digest(store.active()["records"])
    with pytest.raises(versions.Conflict, match="none_active"):
        store.change("records", digest, lambda df: df.withColumn("source_status", F.lit("archived")), versions.registry_faults)
    rules = versions.content_digest(store.active()["rules"])
    with pytest.raises(versions.Conflict, match="nested repetition"):
        store.change("rules", rules, lambda df: df.withColumn("pattern", F.lit("(a+)+")), routing.rule_faults)
    assert store.change("rules", rules, lambda df: df.withColumn("priority", F.lit(20)), routing.rule_faults)["revision"] == 3
    faults = {(r.source_id, r.fault) for r in versions.edited_registry(registry, spark.createDataFrame([("add", "s1", "", "", ""), ("update", "s8", "", "", ""), ("drop", "s2", "", "", "")], change.schema))[1].collect()}
    assert faults == {("s1", "source_exists"), ("s8", "source_missing"), ("s2", "unknown_operation")}
    made = store.backup(str(tmp_path / "kept"))
    assert {d["dataset"]: d["rows"] for d in made["datasets"]} == {"records": 5, "rules": 1} and store.backup_faults(str(tmp_path / "kept"), ("records", "rules")) == []
    assert store.backup_faults(str(tmp_path / "kept"), ("records",)) == ["inventory"] and store.backup_faults(str(tmp_path / "none"), ()) == ["manifest"]
    ids(spark, "z").write.mode("append").parquet(str(tmp_path / "kept/rules"))
    assert "rules: bytes" in store.backup_faults(str(tmp_path / "kept"), ("records", "rules"))


def test_migrations():
    steps = tuple(versions.Migration(i, f"step {i}", lambda d: d) for i in (1, 2, 3))
    done = [(m.version, m.name, m.checksum) for m in steps]
    assert versions.migration_faults(done[:2], steps) == [] and versions.migration_faults([], steps) == []
    assert versions.migration_faults([(1, "other", done[0][2])], steps) and versions.migration_faults([done[1]], steps) and versions.migration_faults(done, steps[:2]) and versions.migration_faults([], steps[1:])


def test_ordered_digest(spark):
    rows = spark.createDataFrame([(i, f"t{i}", float(i)) for i in range(20)], "n long, t string, x double")
    same = versions.ordered_digest(rows.repartition(3), ["n"])
    assert same == versions.ordered_digest(rows, ["n"]) != versions.ordered_digest(rows.withColumn("n", -F.col("n")), ["n"])


def test_built_index(spark, tmp_path, corpus):
    rows = corpus.drop("chunk_id").withColumns({"retrieved_at": F.lit("2026"), "source_status": F.lit("active"), "checksum": X.checksum(F.col("content"))})
    assert index.open_index(rows, str(tmp_path / "none")) == (None, "not_built")
    made = index.build_index(rows, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "en", None, "What are river pumps?"), (2, "sv", None, "pumpar"), (3, "en", "none", "pumps"), (4, "en", None, "volcano")], search.QUESTIONS)
    got = [(r.question_id, r["rank"], r.source_id) for r in search.search(made, asked).orderBy("question_id", "rank").collect()]
    assert got[0] == (1, 1, "a") and {q for q, _, _ in got} == {1, 2}
    one = retrieval.hybrid_search(rows.withColumn("chunk_id", F.concat("source_id", F.lit("--001"))), rows, "What are river pumps?", "en").collect()
    assert [(r.source_id, r.score, r.passage_score) for r in one] == [(r.source_id, r.score, r.passage_score) for r in search.search(made, asked).where("question_id = 1").orderBy("rank").collect()]
    assert index.open_index(rows, str(tmp_path / "index"))[1] == "ready"
    assert index.open_index(rows.where("source_id <> 'b'"), str(tmp_path / "index")) == (None, "stale_or_invalid")
    with pytest.raises(ValueError, match="repeated_id"):
        index.build_index(rows.union(rows), str(tmp_path / "other"))


def test_snapshot(spark, tmp_path):
    import json

    for name, value in (("list", [{"source_id": "a", "x": 1}]), ("object", {"records": [{"source_id": "a"}, {"source_id": "b"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert R.read_snapshot(spark, f"{tmp_path}/list.json").columns == ["source_id", "x"] and R.read_snapshot(spark, f"{tmp_path}/object.json").count() == 2


def test_stale_vectors(spark, corpus):
    """A vector that was made of an older text of a chunk doesn't count."""
    rows = corpus.withColumn("checksum", F.lit("now"))
    v = lambda old: spark.createDataFrame([("a", "now", [1.0, 0.0]), ("b", old, [0.0, 1.0]), ("c", "now", [1.0, 1.0])], "chunk_id string, checksum string, vector array<double>")
    modes = [{r.search_mode for r in retrieval.hybrid_search(rows, rows, "river pumps", "en", vectors=v(old), query_vector=[0.0, 1.0]).collect()} for old in ("now", "before")]
    assert modes == [{"hybrid"}, {"lexical"}]


def test_embedding(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", f"text {i}") for i in range(70)], "chunk_id string, checksum string, content string").coalesce(1)
    provider = lambda texts: [(k, [float(t.split()[1]), float(len(texts))]) for k, t in sorted(enumerate(texts), reverse=True) if t != "text 5"]
    got = {r.chunk_id: r.vector for r in retrieval.embedded(chunks, provider, "m").collect()}
    assert len(got) == 69 and got["c7"] == [7.0, 32.0] and got["c69"] == [69.0, 6.0]
    with pytest.raises(ValueError):
        retrieval.complete_vectors(chunks, retrieval.embedded(chunks, provider, "m"))


def test_resolved_turns(spark):
    said = [
        (1, 0, 0.0, "Tell me about the river pump", "en", "PRODUCT_INFORMATION", ["River Pump"]),
        (1, 1, 10.0, "What does it cost?", "en", "OUT_OF_SCOPE", []),
        (1, 2, 20.0, "And the hose", "en", "PRODUCT_INFORMATION", ["Hose"]),
        (1, 3, 30.0, "Compare both", "en", "OUT_OF_SCOPE", []),
        (1, 4, 40.0, "Vad kostar den?", "sv", "PRODUCT_INFORMATION", []),
        (1, 5, 50.0, "And it?", "en", "OUT_OF_SCOPE", []),
        (2, 0, 0.0, "the river pump", "en", "PRODUCT_INFORMATION", ["River Pump"]),
        (2, 1, 4000.0, "What is it?", "en", "OUT_OF_SCOPE", []),
    ]
    df = spark.createDataFrame(said, "conv_id int, turn int, at double, text string, language string, intent string, matched array<string>")
    got = {(r.conv_id, r.turn): r for r in conversations.resolved_turns(df).collect()}
    assert (got[1, 1].resolved_intent, got[1, 1].query, got[1, 1].topic, got[1, 1].follow_up) == ("PRODUCT_INFORMATION", "River Pump. What does it cost?", "River Pump", True)
    assert got[1, 3].query == "Hose, River Pump. Compare both" and got[1, 3].remembered == 2
    assert (got[1, 4].resolved_intent, got[1, 4].remembered, got[1, 5].follow_up) == ("OUT_OF_SCOPE", 0, False)
    assert not got[2, 1].follow_up and got[2, 1].query == "What is it?"


def replayed(turns, terms, versions):
    """The rules as flat statements over all that a conversation holds: versions is [(at, topics)]; a turn is (at, text, language, intent, matched, categories)."""
    said = lambda pattern, text: bool(re.search("(?i)" + pattern, text))
    informs, acts = {"PRODUCT_INFORMATION", "SERVICE_INFORMATION", "COMPANY_INFORMATION"}, {"FIND_CONTACT", "REQUEST_APPOINTMENT"}
    rows, held, used = [], [], 0.0
    for at, text, language, intent, matched, categories in turns:
        held = held if at - used <= 3600 else []
        compares, own = said(config.HISTORY_REFERENCE, text), matched[0] if len(matched) == 1 else ""
        refers = compares or said(config.FOLLOW_UP, text)
        usable = refers and {c["language"] for c in held} == {language}
        present = lambda c: c["topic"] if not versions or c["topic"] in max(v for v in versions if v[0] <= at)[1] else ""  # noqa: E731, B023
        others = [t for t in dict.fromkeys(map(present, held[::-1])) if t and t != own]
        spoken = [own] * bool(own) + others[: 1 + compares]
        kinds = max(((k, c["kinds"]) for k, c in enumerate(held) if c["kinds"]), default=(0, ()))[1]
        hints = spoken + [terms[k] for k in kinds if k in terms]
        bound = usable and bool(hints)
        vague = intent == "OUT_OF_SCOPE" or (intent == "COMPANY_INFORMATION" and not said(config.EXPLICIT_COMPANY, text))
        resolved = intent
        if refers and not usable:
            held, resolved = [], "OUT_OF_SCOPE" if intent in informs else intent
        if bound and vague and held[-1]["intent"] in informs:
            resolved = held[-1]["intent"]
        topic = own if not refers else (spoken or [""])[0] if bound and len(matched) < 2 else ""
        carried = {"topic": topic or (present(held[-1]) if bound and len(matched) < 2 else ""), "kinds": tuple(sorted(categories)) or (held[-1]["kinds"] if bound else ()), "intent": held[-1]["intent"] if bound and resolved in acts else resolved, "language": language}
        leaves = bool(carried["topic"] or carried["kinds"])
        held = [*held, carried][-4:] if leaves and held[-1:] != [carried] else held
        used = at if leaves or refers else used
        rows.append((resolved, f"{', '.join(dict.fromkeys(hints[:3]))}. {text}"[:500] if bound else text, topic or None, bound, len(held)))
    return rows


def test_resolved_turns_replayed(spark):
    """Random conversations against the rules replayed turn by turn: languages, silences, categories, topics that leave the graph."""
    rng = random.Random(5)
    texts = ["Tell me more", "What does it cost?", "Compare both", "And the company", "Contact them about that", "prices"]
    versions = [(0.0, {"A", "B", "C"}), (500.0, {"A", "C"}), (4000.0, {"B", "C"})]
    talks = {}
    for conv in range(60):
        at, talk = 0.0, []
        for _ in range(rng.randrange(1, 12)):
            at += rng.choice((1.0, 50.0, 300.0, 4000.0 if rng.random() < 0.2 else 10.0))
            intent = rng.choice(("PRODUCT_INFORMATION", "COMPANY_INFORMATION", "OUT_OF_SCOPE", "FIND_CONTACT"))
            talk.append((at, rng.choice(texts), "sv" if rng.random() < 0.1 else "en", intent, rng.sample("ABC", rng.choice((0, 0, 1, 1, 2))), rng.sample(["x", "y"], rng.choice((0, 0, 1, 2)))))
        talks[conv] = talk
    schema = "conv_id int, turn int, at double, text string, language string, intent string, matched array<string>, categories array<string>"
    df = spark.createDataFrame([(c, k, *t) for c, talk in talks.items() for k, t in enumerate(talk)], schema).repartition(3)
    terms = {"x": "the x kind", "z": "never"}
    topics = spark.createDataFrame([(at, lang, t) for at, names in versions for t in names for lang in ("en", "sv")], "at double, language string, topic string")
    for graph, known in ((None, []), (topics, versions)):
        got = {(r.conv_id, r.turn): (r.resolved_intent, r.query, r.topic, r.follow_up, r.remembered) for r in conversations.resolved_turns(df, graph_topics=graph, category_terms={"en": terms, "sv": terms}).collect()}
        assert got == {(c, k): row for c, talk in talks.items() for k, row in enumerate(replayed(talk, terms, known))}


def test_folds_are_linear_and_define_nulls(spark):
    """A key with very many events is read as a stream; requests without a time are admitted and not counted."""
    many = spark.range(200_000).select(F.lit("k").alias("client"), "id", F.timestamp_seconds(F.col("id") / 10).alias("at"))
    assert admission.sliding_admission(many, ["client"], "at", "id", 3, 60.0).where("admitted").count() == 3 * 334
    budget = many.select(F.lit("c").alias("category"), "id", "at", F.lit(1).alias("units"))
    assert admission.reserve_budget(budget, "category", "at", "units", "id", 10**6, 1234).where("admitted").count() == 1234
    odd = spark.createDataFrame([("a", 1, None), ("a", 2, 5), (None, 3, 5), ("a", 4, 5)], "client string, id long, at long").withColumn("at", F.timestamp_seconds("at"))
    assert {r.id: r.admitted for r in admission.sliding_admission(odd, ["client"], "at", "id", 1, 60.0).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_moves_keep_slots_single(spark):
    held = spark.createDataFrame([(1, "a", "s1", "c", "confirmed", 1), (2, "b", "s2", "c", "confirmed", 2)], "booking_id int, session_id string, slot_id string, contact_id string, status string, starts_at int")
    moves = spark.createDataFrame([(1, 1, "a", "s9", "c", 9, 1), (2, 2, "b", "s9", "c", 9, 2), (3, 2, "b", "s8", "c", 8, 3), (4, 2, "b", "s7", "c", 7, 4)], "move_id int, booking_id int, session_id string, slot_id string, contact_id string, starts_at int, at int")
    after, outcomes = admission.rescheduled(held, moves)
    assert {r.booking_id: (r.slot_id, r.starts_at) for r in after.collect()} == {1: ("s9", 9), 2: ("s8", 8)}
    assert {r.move_id: r.outcome for r in outcomes.collect()} == {1: "moved", 2: "slot_unavailable", 3: "moved", 4: "superseded"}


def test_similar_pages_of_whole_texts(spark):
    """Only the tail differs: the first words alone are equal, the whole texts are not."""
    head = " ".join(f"w{i}" for i in range(60))
    rows = [("a", "https://x.org/a", "en", head + " " + " ".join(f"x{i}" for i in range(60))), ("b", "https://x.org/b", "en", head + " " + " ".join(f"y{i}" for i in range(60))), ("c", "https://x.org/c", "en", head + " " + " ".join(f"x{i}" for i in range(1, 60)))]
    df = spark.createDataFrame(rows, "source_id string, canonical_url string, language string, content string")
    near = lambda **kw: {(r.source_id, r.similar_to) for r in duplicates.similar_pages(df, **kw).collect()}
    assert near(first_words=60) == {("b", "a"), ("c", "a")} and near(first_words=None) == {("c", "a")}


def test_similar_pages_of_one_template(spark):
    """Copies of a template with a changed word each, behind outliers with the same rare words, against all pairs; copies are no pairs."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    texts = [[*words[:20], *(f"o{k}_{i}" for i in range(80))] for k in range(3)] + [[f"z{i}" for i in range(30)]]
    for k in range(250):
        own = list(words)
        for at in rng.sample(range(100), rng.choice((0, 1, 2, 5))):
            own[at] = f"c{k}_{at}"
        texts.append(own)
    rows = [(f"s{k:03d}", f"https://x.org/{k:03d}", "en", " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_id string, canonical_url string, language string, content string")
    sets = [set(t) for t in texts]
    want = {}
    for x in range(len(sets)):
        y = next((y for y in range(x) if len(sets[x] & sets[y]) >= 0.95 * len(sets[x] | sets[y])), None)
        if y is not None:
            want[f"s{x:03d}"] = f"s{y:03d}"
    assert {r.source_id: r.similar_to for r in duplicates.similar_pages(df).collect()} == want and len(want) > 100


def test_containing_quotes_of_any_length(spark):
    """Against Python's `in`: quotes of many words, few, one, parts of words, white space alone, empty and null."""
    texts = ["the quick brown fox jumps over the lazy dog", "a lazy\ndog  sleeps", "", None, "foxes jump", "xyz"]
    quotes = ["quick brown fox jumps over the lazy", "own fox ju", "lazy dog", "ick br", "fox", "o", "  ", " ", "", None, "zz", "y\nd", "he quick brown fox jumps over the la", "quick red fox"]
    q = spark.createDataFrame(list(enumerate(quotes)), "q int, text string")
    t = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    made = duplicates.containing(q, t, "q", "t")
    assert {r.q: r.n_documents for r in made.collect()} == {k: sum(x is not None and s is not None and s in x for x in texts) for k, s in enumerate(quotes)}
    assert "CartesianProduct" not in made._jdf.queryExecution().executedPlan().toString()


def test_index_segments(spark, tmp_path):
    """A change of few records writes few postings; search over segments is that of a rebuilt index, before and after merges."""
    from gleaner.operators import segments

    rng = random.Random(9)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(300)]
    row = lambda k, salt: (f"s{k}", f"title {words[k % 300]}", f"https://x.org/{k // 2}", "c", "en", f"sum{k}{salt}", " ".join(rng.choice(words) for _ in range(40)))
    schema = "source_id string, title string, canonical_url string, category string, language string, checksum string, content string"
    held = {k: row(k, "") for k in range(400)}
    asked = spark.createDataFrame([(1, "en", None, f"{words[3]} {words[17]}"), (2, "en", None, f"x{words[40]}y wordb"), (3, "en", "c", words[5])], search.QUESTIONS)
    folder, one_chunk = str(tmp_path / "index"), lambda r: r.withColumn("chunk_id", F.concat("source_id", F.lit("--001")))
    frame = lambda: spark.createDataFrame(list(held.values()), schema).coalesce(2)
    found = lambda i: sorted(map(tuple, search.search(i, asked).collect()))
    segments.update(frame(), folder, one_chunk)
    counts = []
    for step in range(4):
        for k in (step, 100 + step, 200 + step):
            held[k] = row(k, f"new{step}")
        held.pop(300 + step)
        held[1000 + step] = row(1000 + step, "")
        state = segments.update(frame(), folder, one_chunk)
        counts.append([s["rows"] for s in state["segments"]])
    made = segments.Index.read(spark, folder)
    assert counts[0] == [400, 4] and max(len(c) for c in counts) <= segments.FAN and made.dead is not None
    assert segments.update(frame(), folder, one_chunk)["revision"] == state["revision"] + 1  # nothing changed: no segment more
    assert sum(r["rows"] for r in segments._Revisions(spark, folder).latest()["segments"]) >= len(held)
    segments.update(frame(), str(tmp_path / "whole"), one_chunk)
    whole = segments.Index.read(spark, str(tmp_path / "whole"))
    assert found(made) == found(whole) and {tuple(r) for r in made.totals.collect()} == {("en", "c", len(held))}
    merged = segments.merge(spark, folder, [s["name"] for s in state["segments"]])
    assert [s["rows"] for s in merged["segments"]] == [len(held)] and merged["dead"] is None
    assert found(segments.Index.read(spark, folder)) == found(whole) and segments.vacuum(spark, folder, keep=1)


def test_pruned_vectors(spark):
    """The rows of a full scan, from under a tenth of the pairs; language, ties and invalid vectors."""
    import numpy as np

    from gleaner.operators import nearest

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(f"c{k}", "en" if k % 5 else "sv", (centres[k % 40] + 0.15 * rng.normal(size=16)).tolist()) for k in range(2000)]
    rows += [("none", "en", []), ("zero", "en", [0.0] * 16), ("null", "en", None), ("odd", "en", [1.0, 2.0])]
    table = spark.createDataFrame(rows, "chunk_id string, language string, vector array<double>").repartition(3)
    asked = [(q, "en", (centres[q] + 0.1 * rng.normal(size=16)).tolist()) for q in range(12)]
    questions = spark.createDataFrame(asked, "question_id long, language string, vector array<double>")
    made = nearest.clustered(table)
    own = [(i, np.array(v)) for i, lang, v in rows[:2000] if lang == "en"]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    full = {q: sorted(((-cos(np.array(v), x), i) for i, x in own))[:7] for q, _, v in asked}
    got = {}
    for r in nearest.top_k(made, questions, 7).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((-r.similarity, r.chunk_id))
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in full.items()}
    bounded = nearest.first_bounds(made, questions, 7)
    pairs = nearest.compared_pairs(made, bounded, F.col("__least")).count()
    assert 12 * 7 <= pairs < 12 * len(own) / 10
    near = {(r.question_id, r.chunk_id) for r in nearest.within(made, questions, 0.9).collect()}
    assert near == {(q, i) for q, _, v in asked for i, x in own if cos(np.array(v), x) >= 0.9}
    assert nearest.top_k(made, questions, 5000).count() == 12 * len(own)


def test_audit_chain(spark):
    rows = spark.createDataFrame([("t", i, f"act{i}") for i in range(5)], "tenant string, sequence long, action string")
    chain = logs.chained(rows, ["action"], ["tenant"]).cache()
    assert logs.chain_breaks(chain, ["tenant"]).count() == 0 and logs.verified(chain, ["action"], ["tenant"]).where("NOT intact").count() == 0
    first = chain.orderBy("sequence").first()
    assert first.previous_hash == "0" * 64 and first.event_hash == hashlib.sha256(b'{"action":"act0","previous_hash":"' + b"0" * 64 + b'"}').hexdigest()
    forged = chain.withColumn("action", F.when(F.col("sequence") == 2, "forged").otherwise(F.col("action")))
    assert [r.sequence for r in logs.verified(forged, ["action"], ["tenant"]).where("NOT intact").collect()] == [2]


def test_login_throttle_overall(spark):
    """Both limits against a plain form; the first case is refused by the overall limit alone."""
    import random

    def plain(rows, per_peer, overall, window):
        live, out = [], {}
        for at, attempt, peer in sorted((at, attempt, peer) for attempt, peer, at in rows):
            live = [(p, t) for p, t in live if t > at - window]
            out[attempt] = len(live) < overall and sum(p == peer for p, _ in live) < per_peer
            if out[attempt]:
                live.append((peer, at))
        return out

    rng = random.Random(5)
    cases = [[(i, i, 1000 + i) for i in range(12)], [(i, rng.randrange(6), 1000 + rng.randrange(400)) for i in range(500)]]
    for rows in cases:
        df = spark.createDataFrame(rows, "attempt_id long, peer long, at long").withColumn("at", F.timestamp_seconds("at"))
        got = admission.login_throttle(df, 2, 5, 60.0).collect()
        assert {r.id: r.admitted for r in got} == plain(rows, 2, 5, 60)
        assert all((r.retry_after == 0) == r.admitted for r in got)
    assert sum(plain(cases[0], 2, 5, 60).values()) == 5 and sum(plain(cases[0], 2, 100, 60).values()) == 12


def test_chain_log(spark, tmp_path):
    """Three batches and a repeat give the chain of one run; an event at or before its chain's head refuses the whole batch."""
    from gleaner.operators.chains import ChainLog
    from gleaner.operators.versions import Conflict

    rows = spark.createDataFrame([(f"t{k % 3}", k, f"act{k}") for k in range(12)], "tenant string, sequence long, action string")
    log = ChainLog(spark, str(tmp_path / "log"), ["action"], ["tenant"])
    parts = [rows.where("sequence < 4"), rows.where("sequence BETWEEN 4 AND 7"), rows.where("sequence > 7")]
    assert [log.append(p, n) for p, n in ((parts[0], 0), (parts[1], 1), (parts[1], 1), (parts[2], 2), (parts[0], 0))] == [True, True, False, True, False]
    assert {tuple(r) for r in log.entries().collect()} == {tuple(r) for r in logs.chained(rows, ["action"], ["tenant"]).collect()}
    late = spark.createDataFrame([("t0", 9, "late"), ("new", 1, "first")], rows.schema)
    with pytest.raises(Conflict):
        log.append(late, 3)
    assert log.append(late.where("tenant = 'new'"), 3) and {r.tenant for r in log.heads().collect()} == {"t0", "t1", "t2", "new"}
    stream = ChainLog(spark, str(tmp_path / "streamed"), ["action"], ["tenant"])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(stream.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert stream.entries().count() == 12


def test_sequence_digests(spark):
    """Equal for equal sequences however they are dealt; the first differing range is found; a plain form has the same root."""
    rows = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    level = [hashlib.sha256(f'{{"id":{i},"v":"v{i}"}}'.encode()).hexdigest() for i in range(1000)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 10]).encode()).hexdigest() for i in range(0, len(level), 10)]
    a = versions.sequence_digests(rows.repartition(7), ["id"], 10)
    assert a.orderBy(F.desc("level")).first().digest == level[0] == versions.sequence_digests(rows.coalesce(1), ["id"], 10).orderBy(F.desc("level")).first().digest
    b = versions.sequence_digests(rows.withColumn("v", F.when(F.col("id").isin(537, 900), "x").otherwise(F.col("v"))), ["id"], 10)
    assert versions.first_difference(a, b, 10) == (530, 540) and versions.first_difference(a, a, 10) is None
    longer = versions.sequence_digests(rows.union(spark.sql("SELECT 1000L AS id, 'more' AS v")), ["id"], 10)
    low, high = versions.first_difference(a, longer, 10)
    assert low <= 1000 < high or low >= 1000
    assert versions.sequence_digests(rows.limit(0), ["id"]).first().n_rows == 0


def test_long_texts_have_linear_spans(spark):
    """A text of 100,000 lines, nulls, empty texts and several marks."""
    text = "\n".join(f"line {i}" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a\n\n\nb\n")], "k int, t string")
    got = {r.k: r.s for r in df.select("k", X.paragraph_spans(F.col("t"), "\n").alias("s")).collect()}
    assert len(got[1]) == 100_000 and got[1][-1].stop == len(text) and got[2] is None and [(s.start, s.stop, s.label) for s in got[3]] == [(0, 0, "")]
    assert [(s.start, s.stop, s.label) for s in got[4]] == [(0, 2, "a"), (2, 3, ""), (3, 4, ""), (4, 6, "b"), (6, 6, "")]


def test_loads_fail_closed(spark, tmp_path):
    """A changed file, a missing one, one too many, an id that leads outside and a broken edge each refuse; the file is named."""
    import glob
    import os
    import shutil

    from gleaner.operators.versions import Conflict, Versions

    def rules(datasets):
        lost = datasets["edges"].join(datasets["records"].select("source_id"), "source_id", "left_anti")
        return [f"edge of {r.source_id}" for r in lost.limit(3).collect()]

    records = spark.createDataFrame([(f"s{k}", f"text {k}") for k in range(40)], "source_id string, content string")
    edges = spark.createDataFrame([("s1", "x")], "source_id string, object string")
    store = Versions(spark, str(tmp_path / "store"), rules=rules)
    version = store.stage({"records": records.repartition(4), "edges": edges}, "https://x.org/")
    assert store.load(version)["records"].count() == 40
    broken = store.stage({"records": records, "edges": edges.union(edges.selectExpr("'none'", "'y'"))}, "https://x.org/")
    with pytest.raises(Conflict, match="edge of none"):
        store.load(broken)
    for outside in ("../other", "", version + "/../x", None):
        with pytest.raises(Conflict, match="not a version"):
            store.load(outside)
    with pytest.raises(ValueError):
        store.stage({"../records": records}, "https://x.org/")
    files = sorted(glob.glob(str(tmp_path / "store" / version / "records" / "*.parquet")))
    other = spark.createDataFrame([("s0", "forged")], "source_id string, content string")
    other.coalesce(1).write.parquet(str(tmp_path / "forged"))
    forged = glob.glob(str(tmp_path / "forged" / "*.parquet"))[0]
    crc = lambda f: os.path.join(os.path.dirname(f), "." + os.path.basename(f) + ".crc")
    kept = str(tmp_path / "kept")
    shutil.copy(files[1], kept)
    os.remove(crc(files[1]))
    shutil.copy(forged, files[1])
    with pytest.raises(Conflict, match=os.path.basename(files[1])):
        store.load(version)
    shutil.copy(kept, files[1])
    assert store.load(version)["records"].count() == 40
    shutil.copy(forged, files[1].replace("part-", "part-x"))
    with pytest.raises(Conflict, match="unknown"):
        store.load(version)
    os.remove(files[1].replace("part-", "part-x"))
    os.remove(files[1])
    with pytest.raises(Conflict, match="missing"):
        store.load(version)


def test_an_old_format_is_migrated(spark, tmp_path):
    """A folder of format 1 loads as the present format and can be staged in it; a changed step refuses."""
    import json

    from gleaner.operators.versions import FORMAT, Conflict, Versions

    store = Versions(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([("a", "en-GB", None, "0" * 64), ("b", "sv", "archived", "sha256:" + "1" * 64)], "source_id string, language string, source_status string, checksum string")
    version = "0" * 32
    old.write.parquet(str(tmp_path / "store" / version / "records"))
    manifest = {"format": 1, "home_url": "https://x.org/", "datasets": {"records": versions.content_digest(old)}, "created": 1.0}
    (tmp_path / "store" / f"{version}.json").write_text(json.dumps(manifest))
    want = {("a", "en", "active", "sha256:" + "0" * 64), ("b", "sv", "archived", "sha256:" + "1" * 64)}
    assert {tuple(r) for r in store.load(version)["records"].collect()} == want
    new = store.migrate(version)
    assert new != version and store.manifest(new)["format"] == FORMAT and store.migrate(new) == new
    assert {tuple(r) for r in store.load(new)["records"].collect()} == want
    said = json.loads((tmp_path / "store" / f"{new}.json").read_text())
    said["steps"][0][2] = "another"
    (tmp_path / "store" / f"{new}.json").write_text(json.dumps(said))
    (tmp_path / "store" / f".{new}.json.crc").unlink(missing_ok=True)
    with pytest.raises(Conflict, match="differs"):
        store.load(new)


def test_vectors_by_cells(spark, monkeypatch):
    """Questions go once to each cell that they reach; cells of few vectors, groups of many copies and ties change no row."""
    import numpy as np

    from gleaner.operators import nearest

    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 8)).round(3)
    rows = [(k, "en" if k % 4 else "sv", points[k].tolist()) for k in range(400)] + [(1000 + k, "en", points[1].tolist()) for k in range(150)] + [(2000, None, points[2].tolist())]
    table = spark.createDataFrame(rows, "id long, language string, vector array<double>").repartition(3)
    asked = [(q, ("en", "sv", "de", None)[q % 4], points[q].tolist()) for q in range(24)] + [(30, "en", [0.0] * 8), (31, "en", None)]
    questions = spark.createDataFrame(asked, "question_id long, language string, vector array<double>")
    cos = lambda a, b: float(np.cumsum(a * b)[-1] / (np.sqrt(np.cumsum(a * a)[-1]) * np.sqrt(np.cumsum(b * b)[-1])))
    full = {(q, i) for q, lang, v in asked[:24] for _, i in sorted((-cos(np.array(x), np.array(v)), i) for i, other, x in rows if other == lang and lang)[:5]}
    for size in (nearest.CELL, 40):
        monkeypatch.setattr(nearest, "CELL", size)
        made = nearest.clustered(table, "id")
        found = nearest.top_k(made, questions, 5)
        assert {(r.question_id, r.chunk_id) for r in found.collect()} == full
        sent = nearest._best_of_cells(made, nearest._Cells.of(made), nearest.first_bounds(made, questions, 5), 5, False)
        assert sent.groupBy("question_id").count().agg({"count": "max"}).first()[0] <= 5 * max(1, -(-551 // size) + 20)
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "zip_with" not in plan


def test_index_keeps_each_token_once(spark, tmp_path):
    """A record that is one chunk has no tokens beside its postings; those of a record that was cut, or without a text, are kept apart. Merges and older segments too."""
    from pyspark.sql.types import StringType

    from gleaner.operators import segments

    names = ["source_id", "title", "canonical_url", "category", "language", "content", "checksum"]
    long = "alpha beta. " * 300
    rows = [(f"s{k}", f"title{k}", f"u{k}", "c", "en", text, None if text is None else f"sum{k}") for k, text in enumerate(["alpha gamma", long, None, "delta"])]
    records = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    cut = lambda r: index.chunks(r.withColumn("source_status", F.lit("active"))).withColumn("checksum", F.when(F.col("source_id") == "s1", F.col("checksum")).otherwise(F.concat(F.lit("sum"), F.substring("source_id", 2, 9)))).withColumn("checksum", F.when(F.col("source_id") != "s2", F.col("checksum")))
    segments.update(records, str(tmp_path / "i"), cut)
    made = segments.Index.read(spark, str(tmp_path / "i"))
    tokens = lambda i: sorted((r.source_id, r.token, r.category) for r in i.doc_tokens.collect())
    want = sorted([(f"s{k}", t, "c") for k, own in enumerate([("alpha", "gamma", "title0"), ("alpha", "beta", "title1"), ("title2",), ("delta", "title3")]) for t in own])
    assert tokens(made) == want and {r.source_id for r in made.own_tokens.collect()} == {"s1", "s2"}
    assert made.chunks.where("source_id = 's1'").count() > 1 and "odd" not in str(list((tmp_path / "i").rglob("odd")))
    segments.merge(spark, str(tmp_path / "i"), [s["name"] for s in segments._Revisions(spark, str(tmp_path / "i")).latest()["segments"]])
    assert tokens(segments.Index.read(spark, str(tmp_path / "i"))) == want
    old = segments._told(made.postings.drop("category", "whole"), "postings")
    assert old.schema["category"].dataType == StringType() and old.where("whole").count() == 0


def test_lookups_do_not_shuffle_postings(spark, tmp_path):
    """Related tokens and best rows are sent to the index's tables; beyond SENT rows both are shuffled, with the same rows."""
    from gleaner import storage
    from gleaner.operators import search, segments

    names = ["source_id", "title", "canonical_url", "category", "language", "content", "checksum"]
    records = spark.createDataFrame([(f"s{k}", f"t{k}", f"u{k % 9}", "c", "en", f"thereation number{k} eredon{k % 5}", f"sum{k}") for k in range(60)], ", ".join(f"{n} string" for n in names))
    segments.update(records, str(tmp_path / "i"), lambda r: r.withColumn("chunk_id", F.col("source_id")))
    made = segments.Index.read(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "en", None, "thereation eredon3 number7")], search.QUESTIONS)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        found = made.postings.join(search.related_tokens(made, asked), ["language", "token"])
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        rows = search.search(made, asked).collect()
        limit, storage.SENT = storage.SENT, 0
        try:
            apart = made.postings.join(search.related_tokens(made, asked), ["language", "token"])
            assert "BroadcastHashJoin" not in apart._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, apart.collect())) == sorted(map(str, found.collect())) and search.search(made, asked).collect() == rows and rows
        finally:
            storage.SENT = limit
    finally:
        spark.conf.set(conf, was)


def test_spans_of_many_texts_in_one_batch(spark):
    """Texts are cut 64 at a time; nulls and empty texts at any place of a batch keep theirs."""
    texts = [None if k % 50 == 7 else "" if k % 50 == 9 else "\n".join(f"line {k}" for _ in range(k % 5 + 1)) for k in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).select("k", X.paragraph_spans(F.col("t"), "\n").alias("s")).collect()
    assert {r.k: r.s and [x.label for x in r.s] for r in rows} == {k: t if t is None else t.split("\n") for k, t in enumerate(texts)}
