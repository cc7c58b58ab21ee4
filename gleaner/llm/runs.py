"""Periodic runs of words: stretches in which a pattern of words repeats four times or more.

For a period q, every run of length 4q holds three whole blocks of a grid with step q, so two neighbouring grid points
start equal blocks. Prefix hashes find those pairs for all periods and grid points at once; from the first of each
chain the run is extended both ways by a binary search over the length of the common extension, again for all pairs
at once. Words are then compared: a hash that lied is replaced by a scan of that period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEATS, LEAST = 4, 6
#: Pairs of a period and a grid point that are looked at in one go.
PAIRS_AT_ONCE = 1 << 20
#: Odd base of the prefix hashes and the factors that mix word codes, fixed values.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SCHEMA = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Prefixes:
    """Hashes of all stretches of a sequence of word codes, from the sums over its beginnings."""

    def __init__(self, codes: np.ndarray):
        x = (codes.astype(np.uint64) + np.uint64(1)) * BASE
        for shift, factor in zip((30, 27), MIX):
            x = (x ^ (x >> np.uint64(shift))) * factor
        self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes), BASE))))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((x ^ (x >> np.uint64(31))) * self.power[:-1])))

    def same(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from i have the hash of those from i + q."""
        j = i + q
        return (self.sums[i + length] - self.sums[i]) * self.power[q] == self.sums[j + length] - self.sums[j]


def _extension(same: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The largest length up to `most` that `same` holds for, by bisection in all places at once."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        yes = same(middle)
        low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
    return low


def _grid(hashes: Prefixes, n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, grid point) with three equal blocks from it, the first of each chain, for periods from first to last."""
    periods = np.arange(first, last + 1)
    each = n // periods - 1  # points whose block has a whole block after it
    q = np.repeat(periods, each)
    i = (np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each)) * q
    equal = hashes.same(i, q, q)
    ends = np.cumsum(each) - 1
    after, before = np.append(equal[1:], False), np.append(False, equal[:-1])
    after[ends] = False
    before[ends[:-1] + 1] = False
    chain = equal & after & ~before
    return q[chain], i[chain]


def _scanned(codes: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """All maximal stretches of one period, by comparing every word."""
    equal = np.concatenate(([False], codes[:-q] == codes[q:], [False])).astype(np.int8)
    turns = np.flatnonzero(np.diff(equal))
    return [(s, e + q, q) for s, e in zip(turns[::2].tolist(), turns[1::2].tolist())]


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start, then period; codes tell words apart."""
    n = len(codes)
    if n < LEAST:
        return []
    hashes = Prefixes(codes)
    most = max(1, n // REPEATS)
    found: set[tuple[int, int, int]] = set()
    first = 1
    while first <= most:
        last, pairs = first, n // first
        while last < most and pairs + n // (last + 1) <= PAIRS_AT_ONCE:
            last += 1
            pairs += n // last
        q, i = _grid(hashes, n, first, last)
        if len(q):
            forward = _extension(lambda k: hashes.same(i, q, k), n - i - q)  # noqa: B023
            backward = _extension(lambda k: hashes.same(i - k, q, k), i)  # noqa: B023
            found.update(zip((i - backward).tolist(), (i + q + forward).tolist(), q.tolist()))
        first = last + 1
    wrong = {q for s, e, q in found if not (codes[s : e - q] == codes[s + q : e]).all()}
    found = {x for x in found if x[2] not in wrong}.union(*(_scanned(codes, q) for q in wrong))
    least: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        # a run is found under multiples of its period, too, with the same ends
        if e - s >= max(LEAST, REPEATS * q):
            least[s, e] = min(q, least.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in least.items())


def words_of(text: str | None) -> list[bytes]:
    """The runs of bytes other than 0x20 and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(kept).tolist()]


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), change: Callable[[list[bytes], dict], list[bytes]] | None = None) -> DataFrame:
    """Each row's `keep` columns with n_words, runs (start, length, period: by start, then period) and collapsed.

    A run is a stretch of consecutive words with smallest period q and a length of at least max(6, 4q) that no word
    beside it extends; runs may overlap and nest, and all are given. collapsed is the words joined by single spaces,
    without those that some run holds after its first q words. `change(words, kept values)` may give other words for a
    row, in the task. Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows and
    rows with null ids each give a row; other columns are not read, whatever their names. A text is held whole by
    its task, with about 64 bytes for each word and 100 MB for pairs at a time; tables without rows give none.
    """
    names = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(*(F.col(c).alias(k) for k, c in zip(names, keep)), F.col(text_col).alias("text"))
    fields = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in zip(names, keep))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                counts, lists, texts = [], [], []
                for k in range(rows.num_rows):
                    words = words_of(rows.column(len(keep))[k].as_py())
                    if change is not None:
                        words = change(words, {c: rows.column(m)[k].as_py() for m, c in enumerate(keep)})
                    codes: dict[bytes, int] = {}
                    runs = find_runs(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
                    counts.append(len(words))
                    lists.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(b" ".join(collapse(words, runs) if runs else words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.string())], [*names, "n_words", "runs", "collapsed"])

    out = inner.mapInArrow(searched, f"{fields}n_words bigint, runs {SCHEMA}, collapsed string")
    return out.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), "n_words", "runs", "collapsed")


def longest(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.struct((-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period"))
