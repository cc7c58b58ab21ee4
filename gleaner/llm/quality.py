"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

Each word (a run of non-space characters, as written) has hashed features: itself, itself with the word before, and
its character n-grams. A document's vector is the mean over its words of the mean of their features' vectors. Vectors
and output weights are learned together by stochastic gradient descent in numpy, in one task, over a bounded sample of
labelled rows whose features all tasks have computed. Scoring runs over all rows in their partitions.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted to, at most.
SAMPLE_ROWS = 4000
#: Words whose features are computed at once.
WORDS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dim: int = 16
    shortest: int = 3
    longest: int = 5
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7


#: Fixed odd multipliers of the feature hash: one for characters by place, one for the last mix.
_PLACE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(maxsize=8)
def _places(n: int) -> np.ndarray:
    out = np.full(n, _PLACE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _bucket(hashed: np.ndarray, kind: int, s: Settings) -> np.ndarray:
    mixed = (hashed + np.uint64(kind)) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(_MIX) >> np.uint64(33)).astype(np.int64) % s.buckets


def word_features(words: list[str], first: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of the features of a run of words: the words, pairs, then character n-grams by size.

    A pair is a word with the one before in its text; two equal words make the same pair, whichever they are. first
    says which words begin a text and have none before. Words stand side by side between marks, so that one array
    holds them all; an n-gram within one word counts.
    """
    line = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(line)) - begin[word]
    powers = _places(1 << max(6, int(length.max()).bit_length()))
    whole = np.add.reduceat(line * powers[place], begin)
    yield np.arange(len(words)), _bucket(whole, 0, s)
    at = np.flatnonzero(~first)
    yield at, _bucket(np.where(whole[at] == whole[at - 1], 0, whole[at] * np.uint64(_MIX) + whole[at - 1]), 1, s)
    left = length[word] - place
    gram = line.copy()
    for n in range(2, s.longest + 1):
        gram[: len(line) - n + 1] += line[n - 1 :] * powers[n - 1]
        if n >= s.shortest:
            at = np.flatnonzero(left >= n)
            yield word[at], _bucket(gram[at], n, s)


def word_sizes(words: list[str], first: np.ndarray, s: Settings) -> np.ndarray:
    """How many features each word has."""
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return 2 - first + sum(np.maximum(0, length - n + 1) for n in range(s.shortest, s.longest + 1))


def document_features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets with weights that sum to 1; none for a blank text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    total = np.zeros(s.buckets)
    for low in range(0, len(words), WORDS_AT_ONCE):
        before = int(low > 0)  # the last word of the part before, for the pair with the first of this one
        part = words[low - before : low + WORDS_AT_ONCE]
        first = np.arange(len(part)) == 0
        share = np.where(np.arange(len(part)) < before, 0.0, 1 / (word_sizes(part, first, s) * len(words)))
        for word, bucket in word_features(part, first, s):
            total += np.bincount(bucket, share[word], s.buckets)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, output weights, output biases); rows are (buckets, weights, class), in an order that is given."""
    draw = np.random.default_rng(s.seed)
    vectors = draw.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    classes = np.eye(2, dtype=np.float32)
    steps, total = 0, max(1, s.epochs * len(rows))
    for _ in range(s.epochs):
        for k in draw.permutation(len(rows)):
            ids, weights, label = rows[k]
            rate = s.rate * (1 - steps / total)
            steps += 1
            hidden = weights @ vectors[ids]
            logit = out @ hidden + bias
            odds = np.exp(logit - logit.max())
            error = odds / odds.sum() - classes[label]
            back = error @ out
            out -= rate * np.outer(error, hidden)
            bias -= rate * 0.1 * error
            vectors[ids] -= np.outer(weights * (rate / (weights @ weights)), back)  # the text's mean moves by rate * back
    return vectors, out, bias


def _saved(*arrays: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez(held, *arrays)
    return held.getvalue()


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; null ids don't."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, settings: Settings = Settings()) -> bytes | None:
    """The model's arrays, or None without labelled texts.

    Labels are read only of rows that aren't held out. Of an id with several labels the mean counts, 0.5 as 1; ids or
    labels that are null are ignored. The sample is the `sample_rows` ids of least hash. A hash join with this
    bounded sample filters the documents in place; only features of the sample are shuffled.
    """
    s = settings
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = clean.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [document_features(t.as_py(), s) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())], ["id", "label", "ids", "weights"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, label, ids, weights in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if ids:
                    rows.append((i, label, np.frombuffer(ids, np.int32), np.frombuffer(weights, np.float32)))
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1], len(r[2])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([_saved(*fit([(i, w, label) for _, label, i, w in rows], s))], pa.binary())], ["model"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = texts.mapInArrow(featured, f"id {kind}, label int, ids binary, weights binary")
    model = made.repartition(1).mapInArrow(fitted, "model binary").first()
    return bytes(model.model) if model else None


def score(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), settings: Settings = Settings()) -> DataFrame:
    """id_col and `keep` with score (double): the softmax output of class 1 for each row's whole text.

    A blank or null text has the output of an empty document, which its biases alone give. Without a model every
    score is 0.5. The softmax of two classes is a logistic function of the difference of their outputs, which is
    linear in the mean; so each bucket has one weight, and a text's vector need not be formed.
    """
    s = settings
    if model is None:
        return docs.select(id_col, *keep, F.lit(0.5).alias("score"))
    vectors, out, bias = np.load(io.BytesIO(model)).values()
    of_bucket = (vectors @ (out[1] - out[0])).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((of_bucket, float(bias[1] - bias[0])))
    columns = [id_col, *keep]
    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns)), F.col(text_col).alias("text"))
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, base = sent.value

        def numbers(words: list[str], sizes: list[int], again: list[bool]) -> np.ndarray:
            """The mean weight of each word's features; zero for a word that only stands before its text's next part."""
            total, first = np.zeros(len(words)), np.zeros(len(words), bool)
            begin = np.cumsum([0, *sizes[:-1]])
            first[begin] = True
            for word, bucket in word_features(words, first, s):
                total += np.bincount(word, weight[bucket], len(words))
            total[begin[again]] = 0
            return total / word_sizes(words, first, s)

        for batch in batches:
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            held: list[str] = []
            owner: list[int] = []
            sizes: list[int] = []
            again: list[bool] = []

            def settle():
                if held:
                    sums[:] += np.bincount(np.repeat(owner, sizes), numbers(held, sizes, again), batch.num_rows)
                    for listed in (held, owner, sizes, again):
                        listed.clear()

            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                words = (text.as_py() or "").split()
                counts[k] = len(words)
                for low in range(0, len(words), WORDS_AT_ONCE):
                    part = words[max(0, low - 1) : low + WORDS_AT_ONCE]
                    held += part
                    owner.append(k)
                    sizes.append(len(part))
                    again.append(low > 0)
                    if len(held) >= WORDS_AT_ONCE:
                        settle()
            settle()
            scores = 1 / (1 + np.exp(-np.clip(base + sums / np.maximum(counts, 1), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*(f"k{i}" for i in range(len(columns))), "score"])

    return inner.mapInArrow(scored, f"{fields}, score double").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)), "score")
