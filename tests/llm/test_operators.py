"""Operators on small fixtures: nulls, blanks, ties, repeated rows, empty tables, clashing columns, and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import alignment, bpe, chat, components, decontam, hosts, linedup, nearcopies, pseudonyms, quality, queries, runs, sharding, simhash, spotsigs, superminhash
from tests.llm import reference_forms as plain

TEXTS = [(1, "a b c\nd e f\ng h i\nj"), (2, None), (3, ""), (4, "  \n\t "), (5, "a b c\nd e f\ng h i\nk"), (5, "a b c\nd e f\ng h i\nk"), (None, "lone text here"), (6, "word " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    """Every hard case, with columns whose names the operators use themselves."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.withColumns({c: F.lit("x") for c in ("lang", "source", "score", "fp", "bucket", "gone", "n_removed", "spans", "slot", "turns", "k0")}).withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0).cache()


def test_pseudonyms_are_valid_linked_and_reversible(spark):
    key = queries.EXAMPLE_KEY
    for kind, value in {"card": "4845 1681 1440 7329", "ipv4": "97.51.17.173", "date": "2024-02-29", "phone": "+1 (017) 555-7713", "social": "123-45-6789", "mail": "Jane.D34@mail7.example.com", "hex": "04dbebab91ab85687d33eeaaf9ac699e", "iban": "GB82 WEST 1234 5698 7654 32"}.items():
        if kind == "card":
            digits = "484516811440732"
            value = digits + pseudonyms.luhn_digit(digits)
        new = pseudonyms.pseudonym(kind, value, key)
        assert new != value and len(new) == len(value) and [c.isalnum() for c in new] == [c.isalnum() for c in value]
        assert pseudonyms.pseudonym(kind, new, key) is not None, kind  # it validates again
        assert pseudonyms.pseudonym(kind, new, key, back=True) == value
    for kind, value in (("card", "4845168114407320"), ("ipv4", "300.1.1.1"), ("date", "2023-02-29"), ("social", "000-12-3456")):
        assert pseudonyms.pseudonym(kind, value, key) is None


def test_pseudonyms_link_formats():
    key = queries.EXAMPLE_KEY
    day = lambda s: pseudonyms.pseudonym("date", s, key)
    for iso, others in {"2024-02-29": ("2024/02/29", "29.02.2024", "29-02-2024", "29/02/2024", "02/29/2024"), "1999-11-05": ("1999/11/05", "05.11.1999", "05-11-1999", "11/05/1999")}.items():
        y, m, d = day(iso).split("-")
        want = {"/": f"{y}/{m}/{d}", ".": f"{d}.{m}.{y}", "-": f"{d}-{m}-{y}"}
        for s in others:
            new = day(s)
            assert new == (want[s[4]] if s[4] in "/" else f"{m}/{d}/{y}" if s[2] == "/" and int(s[:2]) <= 12 else f"{d}/{m}/{y}" if s[2] == "/" else want[s[2]])
            assert pseudonyms.pseudonym("date", new, key, back=True) == s
    digits = lambda s: "".join(c for c in pseudonyms.replace_all(s, key)[0] if c.isdigit())
    assert len({digits(s) for s in ("+44 20 7946 0958", "+442079460958", "+44-20-7946-0958")}) == 1
    assert len({digits(s)[-10:] for s in ("+1 555-123-4567", "555-123-4567", "(555) 123-4567", "555.123.4567")}) == 1
    assert pseudonyms.pseudonym("mail", "Jane.D3@x.org", key).lower() == pseudonyms.pseudonym("mail", "jane.d3@x.org", key)
    assert pseudonyms.replace_all("\u0660\u0662\u0660-12-3456", key) == ("\u0660\u0662\u0660-12-3456", [])


def test_permutation():
    assert sorted(pseudonyms.permute(i, 1000, b"k" * 16, "t") for i in range(1000)) == list(range(1000))


def test_pseudonyms_hard_cases(docs, empty):
    got = pseudonyms.pseudonymize(docs, queries.EXAMPLE_KEY).collect()
    assert len(got) == len(TEXTS) and sorted(str(r.text) for r in got) == sorted(str(t) for _, t in TEXTS)
    assert pseudonyms.pseudonymize(empty, queries.EXAMPLE_KEY).count() == 0
    assert len(pseudonyms.find("9" * 200_000 + "a" * 200_000 + "@")) == 0


def test_chat_layouts(spark):
    said = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"content":null,"role":"assistant"}]}'),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}'),
        (3, '{"output":"c","instruction":"a","input":"b"}'),
        (4, '{"prompt":"p","completion":"c"}'),
        (5, '{"unknown":{"deep":1}}'),
        (6, "no json"),
        (7, None),
        (8, '{"messages":[]}'),
        (9, '{"messages":[{"role":"u","content":"x","name":"n"}],"id":4}'),
        (10, '{"messages":[{"role":"u","content":"x"}],"prompt":"x"}'),
        (11, '{"output":"c","instruction":"a"}'),
    ]
    got = {r.id: r for r in chat.format_chat(spark.createDataFrame(said, "id int, record string").withColumn("turns", F.lit(0)), "record").collect()}
    turns = {i: None if r.turns is None else [tuple(t) for t in r.turns] for i, r in got.items()}
    assert turns[1] == [("user", "hi"), ("assistant", "")] and turns[2] == [("user", "hi"), ("assistant", "yo")] and turns[3] == [("user", "a"), ("user", "b"), ("assistant", "c")] and turns[4] == [("user", "p"), ("assistant", "c")]
    assert [turns[i] for i in (5, 6, 7)] == [None] * 3 and len(got) == len(said) and turns[8] == []
    assert turns[9] == [("u", "x")] and turns[10] == [("u", "x")] and turns[11] == [("user", "a"), ("assistant", "c")]
    assert {i: r.error for i, r in got.items() if r.error} == {5: "unknown_layout", 6: "not_json", 7: "null_record"}
    assert len({got[i].schema_hash for i in (1, 9)}) == 1  # fields that no layout declares don't count


def test_layouts_that_clash():
    with pytest.raises(ValueError):
        chat.declared((chat.Layout("a", ("x",), ("y",), fields=(("user", "x"),)), chat.Layout("b", ("x", "y"), fields=(("user", "y"),))))


def test_chat_typed_records(spark):
    """Rows of one table in several layouts, without JSON."""
    rows = [(1, [("user", "q"), ("assistant", "a")], None, None, None), (2, None, "p", "c", None), (3, None, None, None, "x"), (4, [], None, None, None), (5, None, "p", None, None)]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>, prompt string, completion string, name string")
    got = {r.id: r for r in chat.canonical_turns(df.select("id", F.struct("messages", "prompt", "completion", "name").alias("r")), "r").collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "q"), ("assistant", "a")] and [tuple(t) for t in got[2].turns] == [("user", "p"), ("assistant", "c")]
    assert got[4].turns == [] and got[3].turns is None and got[3].error == "unknown_layout" and got[5].error == "unknown_layout"


def test_chat_nested_paths(spark):
    """Paths of any depth, lists within structs and structs within elements; typed and JSON; a part list is no text."""
    deep = (
        chat.Layout("deep", ("data.talk.messages",), ("data.talk.messages[].by.name", "data.talk.messages[].body.text"), messages="data.talk.messages", role="by.name", text="body.text", roles=(("human", "user"),)),
        chat.Layout("pair", ("prompt.text", "reply.text"), ("prompt.meta[].k",), fields=(("user", "prompt.text"), ("assistant", "reply.text"))),
        *chat.LAYOUTS[:1],
    )
    said = [
        (1, '{"data":{"talk":{"messages":[{"by":{"name":"human"},"body":{"text":"hi"}},{"by":{"name":"bot"}}]},"more":1}}'),
        (2, '{"prompt":{"text":"p","meta":[{"k":"x"}]},"reply":{"text":"r"}}'),
        (3, '{"prompt":{"text":"p"}}'),
        (4, '{"messages":[{"role":"user","content":"flat"}]}'),
        (5, '{"data":{"talk":{"messages":[]}}}'),
    ]
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(said, "id int, record string"), "record", deep).collect()}
    assert {i: None if r.turns is None else [tuple(t) for t in r.turns] for i, r in got.items()} == {1: [("user", "hi"), ("bot", "")], 2: [("user", "p"), ("assistant", "r")], 3: None, 4: [("user", "flat")], 5: []}
    assert got[3].error == "unknown_layout" and got[1].layout == "deep"
    typed = spark.sql("SELECT named_struct('data', named_struct('talk', named_struct('messages', array(named_struct('by', named_struct('name', 'human'), 'body', named_struct('text', 'hi')))))) AS r")
    assert [tuple(t) for t in chat.canonical_turns(typed, "r", deep).first().turns] == [("user", "hi")]
    parts = spark.sql("SELECT named_struct('messages', array(named_struct('role', 'user', 'content', array('a', 'b')))) AS r")
    row = chat.canonical_turns(parts, "r").first()
    assert row.turns is None and (row.layout, row.error) == ("messages", "not_text")


def test_chat_long_turns(spark):
    """Turns of over 20 million characters stay whole, typed and from JSON."""
    n = 21_000_000
    turns = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), n).alias("text"))
    made = chat.as_records(turns)
    assert chat.canonical_turns(made, "record").select(F.size("turns"), F.length(F.col("turns")[1].text)).first()[:] == (2, n)
    text = made.select(F.to_json(F.struct(F.slice("record.messages", 1, 1).alias("messages"))).alias("record"))
    assert chat.canonical_turns(text, "record").select("error", F.length(F.col("turns")[0].text)).first()[:] == (None, n)


def test_chat_hard_tables(spark):
    """Null numbers, roles and texts, repeated rows, clashing columns, an empty table."""
    rows = [(None, 1, "user", "a"), (None, None, "user", "b"), (7, 2, None, None), (7, 1, "assistant", "x"), (7, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    clash = chat.as_records(df).withColumns({c: F.lit(0) for c in ("layout", "formatted", "loss_mask", "turns", "error")})
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.format_chat(clash, "record").collect()}
    assert got == {None: [("user", "a"), ("user", "b")], 7: [("assistant", "x"), ("assistant", "x"), ("", "")]}
    assert chat.format_chat(chat.as_records(df.limit(0)), "record").count() == 0


def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "\\<|", "<\\|", "<\\\\|x", "\\", "", "a\nb", "<|im_start|>user\n", "<|nl|>", "|>", "<", "<\\\\\\|"]
    rows = [(k, j, role, t) for k, role in enumerate(hard) for j, t in enumerate(hard)]
    made = chat.format_chat(chat.as_records(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")), "record", loss_roles=tuple(hard))
    for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").alias("n"), F.aggregate("loss_mask", F.lit(0), lambda a, m: a + m["before"] + m["chars"] + m["after"]).alias("sum")).collect():
        assert [tuple(x) for x in r.t] == [(hard[r.conv_id], t) for t in hard] and list(r.loss) == hard and r.n == r.sum


def test_quality_learns(spark, docs, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioubdfg") for _ in range(6))
    rows = [(i, " ".join(word() + ("!!" if i % 3 == 0 else "") for _ in range(40)), int(i % 3 != 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df, df.select("doc_id", "quality"), sample_rows=300)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    wrong = [i for i, _, y in rows if plain.held_out(i) and (got[i] >= 0.7) != y]
    assert len(wrong) <= 3
    scored = quality.score(docs, model, keep=("lang", "bucket")).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(empty, model).count() == 0
    none = quality.train(df, df.select("doc_id", "quality").limit(0))
    assert none is None and {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_parts_add_up():
    s = quality.Settings()
    weight = np.random.default_rng(0).normal(size=s.buckets)
    text = "The cat the the Äpfel cat " * 7
    ids, share = quality.document_features(text, s)
    assert share.sum() == pytest.approx(1, abs=1e-5)
    words = text.split()
    first = np.arange(len(words)) == 0
    total = np.zeros(len(words))
    for w, b in quality.word_features(words, first, s):
        total += np.bincount(w, weight[b], len(words))
    assert (total / quality.word_sizes(words, first, s)).mean() == pytest.approx(share @ weight[ids], abs=1e-4)


def test_quality_parts_change_nothing(monkeypatch):
    """A text's features are the same in parts of any size: a part's first word keeps its pair with the word before."""
    s = quality.Settings()
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("one", "two", "two", "three", "fünf")) for _ in range(n)) for n in (1, 5, 6, 23, 60)]
    whole = [quality.document_features(t, s) for t in texts]
    monkeypatch.setattr(quality, "WORDS_AT_ONCE", 6)
    for (ids, weights), t in zip(whole, texts):
        got = quality.document_features(t, s)
        assert (got[0] == ids).all() and got[1] == pytest.approx(weights, abs=1e-6)


def test_quality_scores_of_long_texts(spark):
    """A text of several parts has the score that its features give."""
    s = quality.Settings()
    rng = random.Random(7)
    text = " ".join(rng.choice(("one", "two", "two", "three", "fünf")) for _ in range(2 * quality.WORDS_AT_ONCE + 9))
    rows = spark.createDataFrame([(1, "short text"), (2, text), (3, None)], "doc_id long, text string").coalesce(1)
    vectors, out, bias = np.random.default_rng(1).normal(size=(s.buckets, s.dim)).astype(np.float32), np.random.default_rng(3).normal(size=(2, s.dim)).astype(np.float32), np.zeros(2, np.float32)
    got = {r.doc_id: r.score for r in quality.score(rows, quality._saved(vectors, out, bias)).collect()}
    ids, share = quality.document_features(text, s)
    logit = out @ (share @ vectors[ids]) + bias
    assert got[2] == pytest.approx(np.exp(logit[1]) / np.exp(logit).sum(), abs=1e-4)


def test_sharding(spark, docs, empty):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(spark, names, 1009)
    rows = {r.slot: r.shard for r in table.collect()}
    counts = {n: list(rows.values()).count(n) for n in names}
    assert len(rows) == 1009 and max(counts.values()) - min(counts.values()) <= 1
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:-1], 1009).collect()}
    moved = sum(rows[i] != fewer[i] for i in rows if rows[i] != "s6")
    assert moved < 1009 * 0.25
    got = sharding.place(docs, "doc_id", table, 1009).collect()
    assert len(got) == len(TEXTS) and len({r.shard for r in got if r.doc_id == 5}) == 1 and all(r.shard in names for r in got)
    assert sharding.place(empty, "doc_id", table, 1009).count() == 0
    for bad in (([], 7), (["a"], 8), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, *bad)


def test_spotsigs(spark, docs, empty):
    sig = {r.t: r.s for r in spotsigs.add_signatures(spark.createDataFrame([("the big cat sat on a mat",), ("THE big, cat sat on a mat!",), ("big cat",), ("",), (None,)], "t string"), "t", "s").collect()}
    assert len(sig["the big cat sat on a mat"]) == 3 and sig["the big cat sat on a mat"] == sig["THE big, cat sat on a mat!"]
    assert len(sig["big cat"]) == 1 and sig[""] == sig[None] == []
    led = spotsigs.with_next(docs, "doc_id", "text", "after", buckets=3)
    assert led.count() == len(TEXTS) and spotsigs.with_next(empty, "doc_id", "text", "after").count() == 0
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for buckets in (1, 2, 7, 64):
        assert {r.doc_id: r.after for r in spotsigs.with_next(rows, "doc_id", "text", "after", buckets).collect()} == {i: str(i - 1) if i else "49" for i in range(50)}


def test_spotsigs_near_duplicates(spark, empty):
    rng = random.Random(3)
    common, rare = ["the", "of", "a", "und"], [f"w{i}" for i in range(60)]
    base = [[rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(60)] for _ in range(12)]
    texts = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(w if rng.random() > 0.02 else "zz" for w in b)) for i, b in enumerate(base)] + [(200, " ".join(base[0])), (201, ""), (202, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {r.doc_id: set(r.s) for r in spotsigs.add_signatures(df, "text", "s").collect()}
    parent = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                union = sets[a] | sets[b]
                if not union or len(sets[a] & sets[b]) / len(union) >= 0.8:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.doc_id: r.component_id for r in spotsigs.near_duplicates(df).collect()} == parent
    assert spotsigs.near_duplicates(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    got = linedup.dedup_lines(docs).collect()
    assert len(got) == len(TEXTS)
    by = {(r.doc_id, r.text) for r in got}
    assert (1, TEXTS[0][1]) in by and (5, "k") in by and (2, None) in by and (3, "") in by
    assert [r.n_removed for r in got if r.doc_id == 5] == [3, 3]
    assert linedup.dedup_lines(empty).count() == 0
    rng = random.Random(5)
    texts = [(i, "\n".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for i in range(60)]
    want = plain.deduped_lines(texts)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == want


def test_hosts(spark):
    urls = [(1, "HTTP://A.Example.NET/x?y#z"), (2, None), (3, "no scheme"), (4, "x://h"), (5, "http://example.net/en/1"), (6, "http://org/fr/"), (7, "http://u@b.example.com:80/de/x://y"), (8, "http://h?://q"), (9, "http://h#/x")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({"bad": F.lit(None).cast("int"), "host": F.lit(0), "rate": F.lit(0)})
    for r in hosts.judge(pages, queries.RULES).collect():
        host, path = plain.url_parts(dict(urls)[r.page_id])
        rule, verdict = plain.url_rule(host, path, queries.RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert hosts.judge(pages.limit(0), queries.RULES).count() == 0
    many = [(i, f"http://{'bad' if i % 4 == 0 else f'good{i % 9}'}.x.io/", int(i % 4 == 0)) for i in range(400)] + [(1000, "http://new.x.io/", None)]
    got = {r.host: r.verdict for r in hosts.judge(spark.createDataFrame(many, "page_id long, url string, bad int"), []).collect()}
    assert got["bad.x.io"] == "block" and got["good1.x.io"] == "allow" and len(got) == 11


def test_registered_domains(spark):
    want = {"a.shop.co.uk": ("shop.co.uk", "co.uk"), "u@b.example.com:80": ("example.com", "com"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "[::1]:8080": ("[::1]", "[::1]"), "co.uk": ("co.uk", "co.uk"), "x.org.": ("x.org", "org"), "": ("", ""), "localhost": ("localhost", "localhost")}
    got = spark.createDataFrame([(h,) for h in want], "h string").select("h", hosts.registered_domain(F.col("h")).alias("d"), hosts.suffix(F.col("h")).alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in got} == want


def test_write_shards(spark, docs, tmp_path):
    table = sharding.lookup_table(spark, ["s0", "s1"], 7)
    sharding.write_shards(sharding.place(docs, "doc_id", table, 7), str(tmp_path / "out"), parts=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(TEXTS) and {r.shard for r in back.select("shard").distinct().collect()} <= {"s0", "s1"}


def test_hot_ids_and_next(spark):
    """Ids that fill many ranges, and null ids: every row has one next row, in one circle."""
    rows = [(7, f"a{i}") for i in range(400)] + [(None, f"n{i}") for i in range(100)] + [(i, f"b{i}") for i in range(20)]
    led = spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", "after", buckets=9).collect()
    assert len(led) == 520 and sorted(r.after for r in led) == sorted(t for _, t in rows)
    after = {r.text: r.after for r in led}
    order = ["b19"]
    while after[order[-1]] != "b19":
        order.append(after[order[-1]])
    ids = {t: (-1 if d is None else d) for d, t in rows}
    assert len(order) == 520 and [ids[t] for t in order] == sorted(ids.values(), reverse=True)


def test_spotsigs_hot_signature(spark):
    """A template with one changed word each: one group, found without all its pairs; strays stay apart."""
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(["the"] + [f"z{k}" if i == k % 40 else f"the {w}" for i, w in enumerate(base)])) for k in range(120)]
    rows += [(1000 + k, " ".join(f"the {w}" for w in base[: 20 + k] + [f"q{k}{i}" for i in range(60 - k)])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: plain.chains(t, spotsigs.ANCHORS) for d, t in rows}
    assert {r.doc_id: r.component_id for r in spotsigs.near_duplicates(df).collect()} == plain.near_sets(sets, 0.8)


def test_suffix_order_and_search():
    rng = np.random.default_rng(2)
    for trial in range(40):
        n, sigma = int(rng.integers(1, 200)), int(rng.integers(1, 5))
        s = rng.integers(0, sigma + 1, n)
        if trial % 4 == 0:
            s = np.tile(np.append(rng.integers(1, sigma + 1, 9), 0), 12)  # copies
        s = np.append(s, 0)
        marks = np.cumsum(s == 0)
        key = lambda p: [(0, int(marks[p + k])) if v == 0 else (1, int(v)) for k, v in enumerate(s[p : p + int(np.argmax(s[p:] == 0)) + 1])]
        assert decontam.sorted_suffixes(s).tolist() == sorted(range(len(s)), key=key)
        index = decontam.FMIndex(s)
        for m in (1, 2, 3):
            phrases = rng.integers(1, int(s.max()) + 1, (8, m)) if s.any() else np.empty((0, m), np.int64)
            low, high = index.search(phrases.ravel(), np.arange(len(phrases)) * m, m)
            for p, a, b in zip(phrases, low, high):
                want = [i for i in range(len(s) - m + 1) if (s[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, docs, empty):
    items = [(1, "a b c d"), (2, None), (3, "..."), (4, "lone TEXT here"), (4, "lone text here"), (None, "word"), (5, "x1 é2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9, "0 X1-É2 x1-é2_x3,x4 x5 x6 x7 x8 x9 X10 x11! end a b c d")], "doc_id long, text string"))
    for kw in ({}, {"block_bytes": 1}, {"shard_bytes": 1}, {"pass_bytes": 1}, {"pass_bytes": 20, "block_bytes": 5, "shard_bytes": 90}):
        got = decontam.decontaminate(more, bench, **kw).collect()
        assert len(got) == len(TEXTS) + 1
        known = [(k, t) for k, (_, t) in enumerate(more.collect())]
        want = sorted(map(str, plain.contamination(known, [(i, t) for i, t in items if i is not None]).values()))
        assert sorted(str((r.n_words, r.n_hit, len(r["items"]), plain.sha(",".join(r["items"])), r.n_hit > 0)) for r in got) == want
    last = next(r for r in got if r.doc_id == 9)
    assert "a b c d" not in last.clean_text and last.clean_text.endswith("! end ") and [r.clean_text for r in got if r.doc_id == 2] == [None]
    assert decontam.decontaminate(empty, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_bpe(spark, docs, empty):
    hard = ["<|endoftext|>", "  \n\t  x", "a\u00a0b\u2003c", "\U0001f600\U0001f469\u200d\U0001f680", "don't WE'LL 'sx", "\x00\x1c\x85", "e\u0301 \u0130 ١٢٣ Ⅷ", " " * 300 + "a" * 5000, "", "日本語 テキスト", "!'s '' '"]
    rows = [(k, t) for k, t in enumerate(hard)] + [(50 + d, chr(c) * 2 + "a" + chr(c)) for d, c in enumerate(range(0x80, 0x3100, 7))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    json = queries.tokenizer_json()
    want = plain.bpe(rows)
    made = bpe.encode(df, json)
    texts = dict(rows)
    for r in made.collect():
        assert (len(r.ids), plain.sha(" ".join(map(str, r.ids))), plain.sha(bytes(r.decoded))) == want[r.doc_id]
        assert bytes(r.decoded).decode() == texts[r.doc_id]
        assert not r.ids or (r.ends[-1] == len(texts[r.doc_id]) and list(r.ends) == sorted(r.ends))
    again = {r.doc_id: r.text for r in bpe.decode(made, json).collect()}
    assert again == texts
    odd = spark.createDataFrame([(1, [None, 64, None]), (2, None)], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, json).collect()} == {1: bpe.decode(spark.createDataFrame([(1, [64])], "doc_id int, ids array<int>"), json).first().text, 2: ""}
    for strange in (-1, 10**6):
        with pytest.raises(Exception, match="the vocabulary has ids"):
            bpe.decode(spark.createDataFrame([(1, [strange])], "doc_id int, ids array<int>"), json).collect()
    split = spark.createDataFrame([(1, made.where("doc_id = 3").first().ids[:1])], "doc_id int, ids array<int>")
    assert "\ufffd" in bpe.decode(split, json).first().text
    assert bpe.encode(docs, json, keep=("doc_id", "k0")).count() == len(TEXTS) and bpe.encode(empty, json).count() == 0
    assert bpe.encode(df, json, offsets=False).where("ends IS NOT NULL").count() == 0


def test_covering(spark):
    """Every pair within the threshold meets at a home."""
    rng = np.random.default_rng(4)
    anchors = simhash.Anchors(2)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = x ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    home, reach = {}, {}
    for row, a, at_home in anchors.of(x):
        for r, v in zip(row.tolist(), a.tolist()):
            if at_home:
                assert home.setdefault(r, v) == v
    for row, a, _ in anchors.of(near):
        for r, v in zip(row.tolist(), a.tolist()):
            assert v not in reach.setdefault(r, set())
            reach[r].add(v)
    assert all(home[r] in reach[r] for r in range(200))


def test_simhash_chains(spark, docs, empty):
    rng = random.Random(8)
    fps = [rng.getrandbits(63) for _ in range(40)]
    for _ in range(120):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    rows = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.near_links(rows)).collect()}
    want = plain.components({f: f for f in set(fps)})
    assert {f: roots.get(f, f) for f in set(fps)} == {f: r for f, (_, r) in want.items()}
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(TEXTS) and {r.component_id for r in got if r.fp == 0} == {2}
    assert simhash.simhash_components(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000), (None, 5)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {2000: 2000, 2001: 2000}


def test_pipeline(spark, sf_dir):
    """Each stage of the pipeline against the plain forms, given what the one before it kept."""
    import corpus_pipeline as p
    from gleaner.llm.common import table

    docs = table(spark, sf_dir, "documents")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    first = p.quality_stage(spark, docs, sf_dir).cache()
    assert first.columns == p.COLUMNS and 0 < first.count() <= docs.count()
    second = p.line_stage(spark, first, sf_dir).cache()
    assert dict(rows(second)) == {d: t for d, (t, _, gone) in plain.deduped_lines(rows(first)).items() if not gone or t.strip(" ")}
    third = p.near_duplicate_stage(spark, second, sf_dir).cache()
    assert sorted(d for d, _ in rows(third)) == sorted(set(plain.near_sets(plain.shingle_sets(rows(second)), 0.8).values()))
    fourth = p.decontamination_stage(spark, third, sf_dir).cache()
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = plain.contamination(rows(third), items)
    texts = dict(rows(third))
    for d, t in rows(fourth):
        assert (t == texts[d]) == (not hit[d][4])
    last = p.encoding_stage(spark, fourth, sf_dir)
    assert {r.doc_id: r.text for r in last.collect()} == dict(rows(fourth))
    assert p.run(spark, sf_dir).count() == fourth.count()


def test_pipeline_stages_on_hard_tables(spark, docs, empty, sf_dir):
    """Every stage with null ids and texts, blank and very long texts, repeated rows, clashing columns, and no rows."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
        got = stage(spark, docs, sf_dir)
        assert got.count() <= len(TEXTS) and (name == "byte-level BPE" or got.columns == p.COLUMNS), name
    assert p.line_stage(spark, docs, sf_dir).where("text IS NULL").count() == 1 and p.decontamination_stage(spark, docs, sf_dir).count() == len(TEXTS)


def test_planted_near_copies_are_caught(spark, sf_dir):
    """Recall of 0.9 at least of copies of real texts in which words at random places changed, at similarity 0.8 or more."""
    import corpus_pipeline as p

    rng = random.Random(21)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect() if len(r.text.split()) >= 60][:80]
    rows, planted = [(i, t) for i, t in enumerate(texts)], []
    for i, t in enumerate(texts):
        words = t.split(" ")
        for at in rng.sample(range(len(words)), max(1, len(words) // 90)):
            words[at] = f"changed{at}"
        sets = plain.shingle_sets([(0, t), (1, " ".join(words))])
        if len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8:
            planted.append(1000 + i)
            rows.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in p.near_duplicate_stage(spark, df, sf_dir).collect()}
    assert len(planted) >= 60 and sum(i not in kept for i in planted) >= 0.9 * len(planted)


def test_near_duplicate_stage_without_ids(spark, sf_dir):
    """Null ids, one id with two texts and repeated rows: one row of each group of like texts stays, whatever its id."""
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    rows = [(None, a), (None, a), (None, b), (7, b), (7, c), (7, c), (8, d), (9, d), (0, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_duplicate_stage(spark, docs, sf_dir)
    assert kept.columns == p.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, a), (7, b), (7, c), (8, d), (0, None)], key=repr)
    assert p.near_duplicate_stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicate_stage_by_jaccard(spark, sf_dir, monkeypatch):
    """Groups of texts at similarity 0.8 or more of five-word shingles, by brute force; blocks of a bucket change nothing."""
    import corpus_pipeline as p

    rng = random.Random(12)
    texts = []
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((9, 60, 200, 400)))]
        for copy in range(4):
            own = list(words)
            for _ in range(max(1, len(own) * copy // 100)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(own))
    texts += ["a b c d e f g h", "a b c d e f g h i", "one two", "one  two", "three"]  # 4 of 5 shingles: 0.8 exactly
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert 20 < len(set(label)) < len(texts) - 20
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.near_duplicate_stage(spark, docs, sf_dir).collect()) == sorted(set(label))
    monkeypatch.setattr(nearcopies, "BLOCK", 300)
    assert sorted(r.doc_id for r in p.near_duplicate_stage(spark, docs, sf_dir).collect()) == sorted(set(label))


ODD = ["x", "", None, " ", "  two  spaces ", "tab\tand\r\nbreak;\r\n  next", "<s>plain</s><|endoftext|>", "one ▁ mark", "日本語のテキスト、長い。", "naïve café №5 ﬁ ½", "a\u00a0b\u3000c", "\n\n\nlines\n", "a" * 5000, "=" * 300 + " " * 300 + "-" * 7, "😀👩‍👩‍👧 emoji", "\x00\x01 control"]


def test_alignment_of_odd_texts(spark):
    """Texts with odd white space, scripts, marks and runs against the plain libraries; the parts' size changes nothing."""
    want = plain.aligned(list(enumerate(t or "" for t in ODD)))
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({"block": F.lit("x"), "n_a": F.lit("x")})
    files = queries.tokenizer_json(), queries.piece_model()
    counted = ("n_a", "n_b", "n_groups", "n_links", "groups")
    for n in (1, 5):
        aligned = alignment.cut(alignment.align(rows.repartition(n), *files, outputs=(*counted, "block", "links")))
        found = alignment.scored(aligned, alignment.piece_count(files[1]), ("doc_id", *counted)).collect()
        got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, plain.sha(r.groups) if r.n_a else "", r.n_best, r.count_sum) for r in found}
        assert got == want


def test_alignment_spans(spark, docs, empty):
    """Ids, overlaps and cuts fit together; every byte of the text is covered."""
    files = queries.tokenizer_json(), queries.piece_model()
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    held = alignment.Aligner(*files)
    for r in alignment.align(rows, *files).collect():
        a, b = held.a.length_of[r.ids_a], held.b_length[r.ids_b]
        at = lambda sizes: [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(len(sizes))]
        spans_a, spans_b = at(a.tolist()), at(b.tolist())
        assert [(o.a, o.b) for o in r.overlaps] == [(i, j) for i, x in enumerate(spans_a) for j, y in enumerate(spans_b) if max(x[0], y[0]) < min(x[1], y[1])]
        assert r.cuts == sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    found = alignment.align(docs, *files, keep=("doc_id", "source", "k0")).collect()
    assert len(found) == len(TEXTS) and alignment.align(empty, *files).count() == 0


def test_runs(spark, docs, empty):
    """Random words of few kinds, nested and neighbouring runs, by brute force; a lying hash is told by the words."""
    rng = random.Random(4)
    samples = [[rng.choice(words) for _ in range(rng.choice((5, 6, 30, 80)))] for words in ("ab", "aaab", "abc") for _ in range(150)]
    samples += [list("ab" * 9 + "b" * 9), list("aabaabaabaab" * 4), ["x"] * 5, ["x"] * 6, list("abcd" * 4), list("abcd" * 4)[:-1], []]
    for words in samples:
        codes = {}
        assert runs.find_runs(np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)) == plain.runs_of(words)
    found = {r.doc_id: r for r in runs.periodic_runs(docs, keep=("doc_id", "k0")).collect()}
    assert [tuple(x) for x in found[6].runs] == [(0, 30_000, 1)] and found[6].collapsed == "word" and found[2].runs == [] and found[4].collapsed == ""
    assert runs.periodic_runs(docs).count() == len(TEXTS) and runs.periodic_runs(empty).count() == 0


def test_runs_with_hashes_that_lie(monkeypatch):
    monkeypatch.setattr(runs.Prefixes, "same", lambda self, i, q, length: np.ones(np.broadcast(i, length).shape, bool))
    for words in ("abababababcabc", "aaaaaaabaaaaaa"):
        assert set(runs.find_runs(np.frombuffer(words.encode(), np.uint8).astype(np.int64))) == set(plain.runs_of(list(words)))


def test_superminhash_signatures():
    """Equal sets have equal signatures, in any order and in parts; the estimate's error is below MinHash's."""
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    x = draw(400)
    one = superminhash.signatures([x, x[::-1].copy(), x[:1], draw(0)])
    assert (one[0] == one[1]).all() and (one[2] >> np.uint64(32)).tolist() != [0] * 96 and len(set((one[2] >> np.uint64(32)).tolist())) == 96
    parts = np.minimum(superminhash.signatures([x[:150]]), superminhash.signatures([x[150:]]))
    assert (parts[0] == one[0]).all()
    errors = [[], []]
    for _ in range(300):
        common, a, b = draw(30), draw(15), draw(15)  # Jaccard 0.5
        pair = [np.concatenate((common, a)), np.concatenate((common, b))]
        for k, sign in enumerate((superminhash.signatures, nearcopies.minhashes)):
            s = sign(pair)
            errors[k].append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors[0])) < 0.02 and np.var(errors[0]) < 0.85 * np.var(errors[1])


def test_superminhash_hard_tables(spark, docs, empty):
    found = superminhash.near_duplicates(docs).collect()
    assert len(found) == len(TEXTS)
    by_id = {r.doc_id: r for r in found if r.doc_id not in (5, None)}
    assert all(by_id[d].n_shingles == 0 and by_id[d].component_id == d and by_id[d].kept for d in (2, 3, 4)) and by_id[6].n_shingles == 1
    assert [r.component_id for r in found if r.doc_id == 5] == [5, 5] and superminhash.near_duplicates(empty).count() == 0
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]


def test_many_copies_of_one_template(spark):
    """Each copy has another changed word: all are linked through the hub, and no pair of copies is made."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for d in range(1, 3001):
        own = list(words)
        own[rng.randrange(120)] = f"x{d}"
        rows.append((d, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in superminhash.near_duplicates(table).collect()} == {0}
    signed = nearcopies.shingle_sets(table.withColumn("mark", F.xxhash64("text")), "text", ["doc_id", "mark"], 4)
    shared = nearcopies.bucket_members(signed)
    assert nearcopies.hub_pairs(shared, signed, 0.8).count() < 12 * len(rows)


def test_near_copies_through_anchors(spark):
    """SimHash anchors give near copies without any band; the exact check follows, and what they can't reach comes by bands."""
    rng = random.Random(4)
    texts = [[f"w{k}_{rng.randrange(5000)}" for _ in range(600)] for k in range(5)]
    for t in list(texts):
        texts += [[*t[:at], "changed", *t[at + 1 :]] for at in rng.sample(range(600), 6)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    signed = nearcopies.shingle_sets(docs, "text", ["doc_id"], 5).cache()
    pairs = nearcopies.anchor_pairs(signed)
    fps = {r.node: r.fp & (1 << 64) - 1 for r in signed.collect()}
    near = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (fps[a] ^ fps[b]).bit_count() <= 2}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}

    def joined(links):
        root = {}
        for a, b in links:
            x, y = (min(root.get(k, {k})) for k in (a, b))
            both = root.get(x, {x}) | root.get(y, {y})
            root |= dict.fromkeys(both, both)
        return set(map(frozenset, root.values()))

    assert got and joined(got) == joined(near)
    sets_of = lambda nodes: nearcopies.hash_sets(docs, "text", 5).join(nodes, "node", "left_semi")
    blind = signed.withColumn("bands", F.array().cast("array<bigint>"))
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in nearcopies.near_links(blind, sets_of, 0.8, pairs).collect()}
    assert links == got
    m = {r.node: r.m.doc_id for r in signed.collect()}
    far = next((a, b) for a in m for b in m if m[a] == 0 and m[b] == 1)
    wrong = spark.createDataFrame([far], "a long, b long")
    assert nearcopies.near_links(blind, sets_of, 0.8, wrong).count() == 0
    assert {r.doc_id for r in nearcopies.first_of_near_copies(docs, ["doc_id"]).collect()} == set(range(5))


def test_anchor_candidates_are_judged_with_the_hubs(spark):
    """Anchors' pairs cost no reading of texts and no check of their own: sets are asked for twice, for hubs with anchors and for parts."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k % 3}_{i}" for i in range(200)) + f" end{k}") for k in range(12)], "doc_id long, text string")
    signed = nearcopies.shingle_sets(docs, "text", ["doc_id"], 5).cache()
    asked = []

    def sets_of(nodes):
        asked.append(nodes)
        return nearcopies.hash_sets(docs, "text", 5).join(nodes, "node", "left_semi")

    links = nearcopies.near_links(signed, sets_of, 0.8, nearcopies.anchor_pairs(signed))
    roots = components.connected_components(links)
    assert len(asked) == 2 and roots.count() == 12 and roots.select("root").distinct().count() == 3
