"""SimHash near-duplicates found through anchor points of a covering code.

Fingerprints: 64 bits, the majority of the XXH64 values of word shingles. Two perfect binary Golay codes of
length 23 lie side by side over the low 46 bits; their 2^24 pairs of codewords are the anchors. Each half of a
fingerprint has exactly one codeword within the covering radius 3: its home. A fingerprint x within t bits of y
differs from y in t1 bits of the first half and t2 of the second, t1 + t2 <= t, so the home of x is within
3 + t1 and 3 + t2 of y's halves. y is therefore copied to every anchor that near (61 on average for t = 2), and
within an anchor only fingerprints at home are compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut
from gleaner.llm.components import connected_components

SEED = 42
#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY = 0xC75
LENGTH, CHECKS, RADIUS = 23, 11, 3
#: Pairs that are compared at once in one task.
PAIRS_AT_ONCE = 1 << 21


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, A-Z lower-cased, repeats included; one hash if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits at 0x20 and 0x09-0x0D, as bytes do
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, `keep`) for each row; null and blank texts have fingerprint zero. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    kept = [f"k{i}" for i in range(len(keep))]
    fields = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *kept])

    out = rows.mapInArrow(signed, "doc_id long, fp long" + fields)
    return out.select("doc_id", "fp", *(F.col(k).alias(c) for k, c in zip(kept, keep)))


class Anchors:
    """Error patterns of the Golay code by syndrome and by how far they go beyond the covering radius."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        self.check = np.array([self._remainder(m << CHECKS) for m in range(1 << (LENGTH - CHECKS))], np.int64)
        patterns = np.zeros(1, np.int64)
        levels: list[list[np.ndarray]] = [[patterns]]
        for _ in range(RADIUS + threshold):
            top = np.array([int(p).bit_length() for p in patterns])
            patterns = np.concatenate([patterns[top <= b] | (1 << b) for b in range(LENGTH)])
            levels.append([patterns])
        within = np.concatenate([x[0] for x in levels[: RADIUS + 1]])
        groups = [within] + [levels[RADIUS + t][0] for t in range(1, threshold + 1)]
        self.by_excess = []
        for group in groups:
            syndrome = self.syndrome(group)
            order = np.argsort(syndrome, kind="stable")
            counts = np.bincount(syndrome, minlength=1 << CHECKS)
            self.by_excess.append((group[order], counts, np.cumsum(counts) - counts))

    @staticmethod
    def _remainder(value: int) -> int:
        while value.bit_length() > CHECKS:
            value ^= GOLAY << (value.bit_length() - CHECKS - 1)
        return value

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.check[x >> CHECKS] ^ (x & ((1 << CHECKS) - 1))

    def of(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, their anchors, whether these are at home), each anchor within radius and threshold once."""
        low = (1 << LENGTH) - 1
        x, y = (fps & np.uint64(low)).astype(np.int64), ((fps >> np.uint64(LENGTH)) & np.uint64(low)).astype(np.int64)
        sx, sy = self.syndrome(x), self.syndrome(y)
        for ex in range(self.threshold + 1):
            for ey in range(self.threshold + 1 - ex):
                px, nx, ax = self.by_excess[ex]
                py, ny, ay = self.by_excess[ey]
                each = nx[sx] * ny[sy]
                row = np.repeat(np.arange(len(fps)), each)
                k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                of_y = ny[sy[row]]
                cx = x[row] ^ px[ax[sx[row]] + k // of_y]
                cy = y[row] ^ py[ay[sy[row]] + k % of_y]
                yield row, (cx >> CHECKS) << (LENGTH - CHECKS) | cy >> CHECKS, not ex and not ey


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each node, with the same components as the links a-b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        new = np.minimum(new[label], new)
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _links_of_groups(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole groups, sorted by anchor, home first: each row is compared with the homes of its anchor."""
    first = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    group = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    homes = np.bincount(group, weights=home, minlength=len(begin)).astype(np.int64)
    alone = np.diff(np.append(begin, len(anchor))) < 2
    each = np.where(alone, 0, homes)[group]
    done = np.cumsum(each)
    low = 0
    while low < len(anchor):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
        part = each[low:high]
        if part.any():
            row = np.repeat(np.arange(low, high), part)
            k = np.arange(len(row)) - np.repeat(np.cumsum(part) - part, part)
            x, y = fp[row], fp[begin[group[row]] + k]
            near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
            if near.any():
                yield forest(x[near].view(np.int64), y[near].view(np.int64))
        low = high


def near_links(distinct: DataFrame, threshold: int = 2, partitions: int | None = None) -> DataFrame:
    """(a, b) links whose components are those of all pairs of `distinct.fp` within `threshold` bits.

    A task holds one anchor's fingerprints (9 bytes each) and a block of compared pairs. Equal fingerprints
    are one row here, so copies never meet; an anchor's links leave as a forest, not as all pairs.
    """
    spark = distinct.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(threshold)
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                for row, anchor, home in anchors.of(fps):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fps[row].view(np.int64)), pa.array(np.full(len(row), home))], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, bool)]

        def out(parts):
            for a, b in parts:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                whole = int(np.searchsorted(held[0], held[0][-1]))
                yield from out(_links_of_groups(*(x[:whole] for x in held), threshold))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield from out(_links_of_groups(*held, threshold))

    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = distinct.select("fp").repartition(partitions).mapInArrow(replicate, "anchor int, fp long, home boolean")
    dealt = copies.repartition(partitions, "anchor").sortWithinPartitions("anchor", F.desc("home"))
    return dealt.mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, component_id, root_fp long, `keep`): component_id is the smallest doc_id reachable over links of `threshold` bits; ids are cast to long.

    One row for each input row, repeated rows and null ids too. Null or blank texts share fingerprint zero and
    are linked like any other. Null ids never become a component_id unless all of a component are null. root_fp, the
    component's least fingerprint as a signed number, tells components apart where ids are null or repeat.
    """
    signed = cut(fingerprints(docs, id_col, text_col, shingle, keep))
    distinct = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(distinct, threshold))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root_fp"))
    named = rooted.join(rooted.groupBy("root_fp").agg(F.min("least").alias("component_id")), "root_fp").select("fp", "component_id", "root_fp")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id", "root_fp", *keep)
