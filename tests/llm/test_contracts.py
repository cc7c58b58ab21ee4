"""Each registered query against a plain form of its contract, over the whole small tables."""

import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality, queries, spotsigs
from gleaner.llm.common import table
from tests.llm import reference_forms as plain


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]


def rows(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def test_op1_pseudonyms(spark, sf_dir, docs):
    """Whole texts against a plain form that finds, validates and permutes on its own."""
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op1_pseudonyms")}
    assert len(got) == len(docs) and sum(r.n_found > 0 for r in got.values()) > 5
    for d, t in docs:
        assert got[d].text == plain.pseudonymous(t, queries.EXAMPLE_KEY)


def test_op2_chat(spark, sf_dir):
    turns = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", queries.CONTROL), (-1, 1, "assistant", queries.CONTROL)]
    want = plain.chat(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows(spark, sf_dir, "op2_chat_format")}
    assert got == want


def test_op3_quality(spark, sf_dir, docs):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op3_quality")}
    assert len(got) == len(docs)
    assert all(r.held_out == plain.held_out(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())


def test_op3_quality_held_out(spark, sf_dir):
    """On labels that no model saw: 95 % right at least, and one good document in a hundred rejected at most."""
    wider = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in table(spark, wider, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).collect()}
    seen = [(r.predicted, labels[r.doc_id]) for r in rows(spark, wider, "op3_quality") if r.held_out and r.doc_id in labels]
    good = [p for p, y in seen if y == 1]
    assert len(seen) > 60 and sum(p == y for p, y in seen) >= 0.95 * len(seen) and good.count(0) <= max(1, len(good) // 100)


def test_op3_scores_are_the_models(spark, sf_dir, docs):
    """The score in full, from vectors: the mean over words of the mean of their features, then a softmax."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    vectors, out, bias = np.load(io.BytesIO(model)).values()
    got = {r.doc_id: r.score for r in rows(spark, sf_dir, "op3_quality")}
    for d, t in docs[:60]:
        words = t.split()
        hidden = np.zeros((len(words), vectors.shape[1]))
        counts = np.zeros(len(words))
        for w, b in quality.word_features(words, np.arange(len(words)) == 0, quality.Settings()) if words else ():
            np.add.at(hidden, w, vectors[b])
            np.add.at(counts, w, 1)
        logit = out @ (hidden / counts[:, None]).mean(axis=0) + bias if words else bias
        assert got[d] == pytest.approx(np.exp(logit[1]) / np.exp(logit).sum(), abs=1e-4)


def test_op5_spotsigs(spark, sf_dir, docs):
    want = plain.edited(docs)
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op5_spotsigs")}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == {d: w[:2] for d, w in want.items()}
    by_text = {}
    prints = {d: r.fingerprint for d, r in got.items()}
    ids = sorted(got, reverse=True)
    for d, other in zip(ids, ids[1:] + ids[:1]):
        sets = [set(re.findall("." * 8, x)) for x in (prints[d], prints[other], got[d].edited_fingerprint)]
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[d].near_next == pytest.approx(near(sets[0], sets[1]))
        assert got[d].near_edited == pytest.approx(near(sets[0], sets[2]))
    for d, t in docs:
        assert by_text.setdefault(t, prints[d]) == prints[d]
    own = {d: plain.chains(t, spotsigs.ANCHORS) for d, t in docs}
    for d, c in own.items():  # one hash for each chain, and equal chains share it
        assert len(prints[d]) == 8 * len(c)
        other = ids[(ids.index(d) + 1) % len(ids)]
        assert got[d].near_next == pytest.approx(near(c, own[other]))


def test_spotsigs_groups(spark, sf_dir, docs):
    own = {d: plain.chains(t, spotsigs.ANCHORS) for d, t in docs}
    assert {r.doc_id: r.component_id for r in rows(spark, sf_dir, "spotsigs_groups")} == plain.near_sets(own, 0.8)


def test_op6_lines(spark, sf_dir, docs):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows(spark, sf_dir, "op6_line_dedup")}
    assert got == plain.deduped_lines(docs)


def test_op7_hosts(spark, sf_dir):
    urls = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    got = rows(spark, sf_dir, "op7_host_reputation")
    assert len(got) == len(urls)
    for r in got:
        host, path = plain.url_parts(urls[r.page_id])
        rule, verdict = plain.url_rule(host, path, queries.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_op8_decontamination(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows(spark, sf_dir, "op8_decontamination")}
    assert got == plain.contamination(docs, items)


def test_op9_bpe(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, sf_dir, "op9_byte_bpe")}
    assert got == plain.bpe(docs)


def test_op10_simhash(spark, sf_dir, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf_dir, "op10_simhash")}
    assert got == plain.components({d: plain.simhash(t) for d, t in docs})


def test_op11_alignment(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in rows(spark, sf_dir, "op11_alignment")}
    assert got == plain.aligned(docs)


def test_op12_periodic_runs(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows(spark, sf_dir, "op12_periodic_runs")}
    assert got == {d: plain.periodic(d, t) for d, t in docs}
    assert sum(r[0] > 0 for r in got.values()) > len(docs) // 20


def test_op13_superminhash(spark, sf_dir, docs):
    sets = {d: plain.shingles_of(t) for d, t in docs}
    label = plain.near_sets({d: s for d, s in sets.items() if s}, 0.8)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, sf_dir, "op13_superminhash")}
    assert got == {d: (len(s), label.get(d, d), label.get(d, d) == d) for d, s in sets.items()}
