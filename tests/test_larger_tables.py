"""Queries against DuckDB on tables that differ from the test tables in what larger ones have: high keys, many rows of one value."""

import os
import random

import duckdb
import pytest

from gleaner.llm import spotsigs
from gleaner.operators import admission, conversations, duplicates, graph
from gleaner.plans import catalogue
from tests.test_oracle import TABLES, plain


@pytest.fixture
def tables(tmp_path, sf_dir):
    """make(name=SELECT over the test tables): (folder, DuckDB connection) of the test tables with those replaced."""

    def make(**changed):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t}_0 AS SELECT * FROM '{sf_dir}/{t}.parquet'")
            if t in changed:
                con.execute(f"COPY ({changed[t]}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        return str(tmp_path), con

    return make


def same_rows(spark, folder, con, name):
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})").fetchall()), key=repr)
    assert got == want and got


def test_booking_moves_of_over_a_million_events(spark, tables):
    """New slots have the numbers of events, on both sides of the first new slot."""
    same_rows(spark, *tables(events="SELECT * REPLACE (event_id + CASE WHEN event_id < 500 THEN 999990 ELSE 1499600 END AS event_id) FROM events_0"), "booking_moves")


def shuffled(spark, run):
    """MB that run() writes to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = lambda: spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    listed = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (seq.apply(k) for seq in (stages(),) for k in range(seq.size()))}
    before = max(listed(), default=-1)
    run()
    return sum(n for k, n in listed().items() if k > before) / 1e6


def test_similar_pages_deal_out_rare_words_alone(spark):
    """A shuffle of all words of all texts several times over is eight times the texts; unlike texts send a few rare words each."""
    rng = random.Random(1)
    rows = [(f"s{k}", f"https://x.org/{k}", "en", " ".join(f"w{int(10 ** (5 * rng.random()))}" for _ in range(600))) for k in range(1500)]
    rows += [("copy", "https://x.org/zz", "en", rows[7][3] + " more")]
    df = spark.createDataFrame(rows, "source_id string, canonical_url string, language string, content string").repartition(4)
    found = []
    moved = shuffled(spark, lambda: found.extend(duplicates.similar_pages(df).collect()))
    assert [tuple(r) for r in found] == [("copy", "s7")]
    assert moved < sum(len(r[3]) for r in rows) / 1e6 * 3


def test_alias_of_many_entities(spark, tables):
    """An alias of many entities is told by an aggregate; a window would write the list of all entities beside each row."""
    same_rows(spark, *tables(customer="SELECT * REPLACE (c_custkey + 1500 * r.range AS c_custkey) FROM customer_0, range(20) r"), "alias_issue_lists")
    rows = [(2, "a", "One", "en", "s"), (1, "a", "one", "en", "s"), (3, "b", "two", "en", "s"), (4, "c", "TWO", "en", "s"), (5, "b", "two", "sv", "s"), (6, None, None, "en", "s")]
    a = spark.createDataFrame(rows, "row int, entity string, alias string, language string, source_id string")
    known = spark.createDataFrame([("a", "b"), ("c", "c")], "subject string, object string")
    made = graph.alias_issues(a, known, spark.createDataFrame([("s",)], "source_id string"))
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.row: r.issues for r in made.collect()} == {1: [], 2: ["duplicate_alias"], 3: ["ambiguous_alias"], 4: ["ambiguous_alias"], 5: [], 6: ["malformed"]}


def test_spotsigs_deal_out_rare_signatures_alone(spark):
    """Signatures are ranked where their sets are: all of them in shuffles were several times the rare ones, and most of these are in no other set."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"the w{rng.randrange(100000)} w{rng.randrange(100000)}" for _ in range(1200))) for k in range(400)]
    rows += [(1000, rows[7][1] + " the end"), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = []
    moved = shuffled(spark, lambda: found.extend(spotsigs.near_duplicates(df).collect()))
    assert {r.doc_id: r.component_id for r in found} == {k: 7 if k == 1000 else k for k, _ in rows}
    assert moved < 400 * 1200 * 4 / 1e6 * 12


def most_rows(spark, run):
    """The most rows that a task of run() reads from shuffles."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    listed = lambda: (seq.apply(k) for seq in (store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()),) for k in range(seq.size()))
    before = max((s.stageId() for s in listed()), default=-1)
    run()
    tasks = (seq.apply(k) for s in listed() if s.stageId() > before for seq in (store.taskList(s.stageId(), s.attemptId(), 1000),) for k in range(seq.size()))
    return max(t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined())


def test_folds_sort_long_keys_in_pieces(spark, monkeypatch):
    """One task sorted all rows of a key; now it sorts a piece, and the state goes on to the next."""
    rng = random.Random(4)
    turns = spark.createDataFrame([(rng.randrange(60), float(rng.randrange(9000)) if k % 50 else None, k) for k in range(4000)], "conv_id long, at double, turn long").repartition(4).cache()
    attempts = turns.selectExpr("turn AS attempt_id", "conv_id AS peer", "timestamp_seconds(at + if(at > 7000, 5000, 0)) AS at")
    whole = [
        lambda: conversations.remembered_conversations(turns, 30, 40.0).collect(),
        lambda: admission.login_throttle(attempts, 2, 20, 60.0).collect(),
        lambda: admission.recent_client_admission(attempts, "peer", "at", "attempt_id", 2, 600.0, 25).collect(),
        lambda: admission.sliding_admission(attempts.selectExpr("if(peer < 50, null, peer) AS peer", "attempt_id", "at"), ["peer"], "at", "attempt_id", 20, 60.0).collect(),
    ]
    want = [sorted(f(), key=repr) for f in whole]
    monkeypatch.setattr(admission, "PIECE", 500, raising=False)
    got = []
    assert most_rows(spark, lambda: got.append(whole[0]())) < 1500
    got += [f() for f in whole[1:]]
    assert [sorted(g, key=repr) for g in got] == want and len(want[1]) == 4000


#: Empty, null and blank texts, white space that SQL doesn't strip or part paragraphs by, and several empty lines in a row.
ODD_TEXTS = """SELECT * REPLACE (CASE doc_id % 40 WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN chr(10) || ' ' || chr(10) WHEN 4 THEN chr(160) || text || chr(11) WHEN 5 THEN replace(text, ' ', chr(10) || chr(10) || chr(10))
  WHEN 6 THEN replace(text, ' ', chr(10) || chr(160) || chr(10)) WHEN 7 THEN replace(text, ' ', chr(10) || chr(12) || chr(10)) WHEN 8 THEN chr(12) || text WHEN 9 THEN replace(text, ' ', ' ' || chr(11)) ELSE text END AS text) FROM documents_0"""


def test_chunk_counts_of_odd_texts(spark, tables):
    """A blank text has no chunk."""
    same_rows(spark, *tables(documents=ODD_TEXTS), "chunk_counts")


def test_chunk_invariants_of_odd_texts(spark, tables):
    """A chunk is within the limit by its length, also where it joins paragraphs that several empty lines part."""
    same_rows(spark, *tables(documents=ODD_TEXTS), "chunk_invariants")


def test_chunk_packing_of_odd_texts(spark, tables):
    """Other white space than SQL's neither parts paragraphs nor is stripped."""
    same_rows(spark, *tables(documents=ODD_TEXTS), "chunk_packing")


def test_chunk_rows_of_odd_texts(spark, tables):
    same_rows(spark, *tables(documents=ODD_TEXTS), "chunk_rows")


def test_near_duplicates_by_whole_texts(spark, tables):
    """Texts of the same first 2,000 words with three kinds of endings, one word of each its own; some begin with their endings."""
    words = lambda w: f"(SELECT string_agg({w}, ' ' ORDER BY range) FROM range({2000 if w.startswith(chr(39) + 'w') else 1500}))"
    head, end = words("'w' || range"), words("'x' || (doc_id % 3) || '_' || range")
    text = f"CASE WHEN doc_id < 12 THEN {head} || ' ' || {end} || ' own' || doc_id WHEN doc_id < 18 THEN 'own' || doc_id || ' ' || {end} || ' ' || {head} ELSE text END"
    folder, con = tables(documents=f"SELECT * REPLACE ({text} AS text, 'web' AS source, CASE WHEN doc_id < 18 THEN 'en' ELSE lang END AS lang) FROM documents_0")
    found = {r.source_id: r.similar_to for r in catalogue.QUERIES["near_duplicates_first"](spark, folder).collect()}
    first = {0: "doc_0", 1: "doc_1", 2: "doc_11"}  # by text
    assert {k: v for k, v in found.items() if int(k[4:]) < 18} == {f"doc_{k}": first[k % 3] for k in range(18) if f"doc_{k}" != first[k % 3]}
    same_rows(spark, folder, con, "near_duplicates_first")


def test_near_duplicates_without_words(spark, tables):
    """Sets without words are equal, as in SQL, in each language."""
    same_rows(spark, *tables(documents="SELECT * REPLACE (CASE WHEN doc_id < 60 THEN CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '...' WHEN 2 THEN NULL WHEN 3 THEN repeat('!', doc_id::INT) ELSE text END ELSE text END AS text) FROM documents_0"), "near_duplicates_first")
