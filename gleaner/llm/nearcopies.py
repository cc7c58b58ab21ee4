"""Near copies by the Jaccard similarity of their word shingles.

Candidates are sets that share a band of MinHash values and over 0.6 of all values' low bytes; every candidate pair is
then judged by its exact similarity. With 24 bands of 4 values a pair of similarity 0.8 shares no band with probability
(1 - 0.8^4)^24 = 3.2e-6, and too few of 96 values with 4e-7; a closer pair with less. Where asked for, sets that SimHash
anchors link are candidates, too; they cannot find all: sets of similarity 0.8 differ in about 10 of 64 bits, some in 18.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut
from gleaner.llm.components import connected_components
from gleaner.llm.simhash import SEED, majority, shingle_hashes
from gleaner.llm.simhash import near_links as anchor_links

BANDS, ROWS = 24, 4
#: Shingle hashes of a bucket that meet in one block; a task compares two blocks at most.
BLOCK = 1 << 20
#: Odd factors of the MinHash functions, fixed values.
FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingle hashes."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (FACTORS[:, None] * found[None, at : at + 4096]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One hash for each band of MinHash values, with the band's number in its low five bits."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)
    return (hashes & ~np.uint64(31) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def likely(same: np.ndarray, similarity: float) -> np.ndarray:
    """Whether so many of a pair's 96 places agree that it may have the similarity: of pairs of 0.8, all but 4e-7 agree in over 0.6 of them."""
    return same >= (similarity - 0.2) * BANDS * ROWS


def alike(sketches: np.ndarray, part: np.ndarray, side: np.ndarray | None, band: int, similarity: float) -> np.ndarray:
    """Which rows may have the similarity with one of another part; with `side`, of the other side.

    A pair that agrees in an earlier band's bytes is met in that band's bucket, and not looked at here.
    """
    found = np.zeros(len(sketches), bool)
    words = np.ascontiguousarray(sketches).view(np.uint32)
    for x in range(len(sketches) - 1):
        same = (part[x + 1 :] != part[x]) & likely((sketches[x + 1 :] == sketches[x]).sum(axis=1), similarity)
        same &= ~(words[x + 1 :, :band] == words[x, :band]).any(axis=1)
        if side is not None:
            same &= side[x + 1 :] != side[x]
        found[x + 1 :] |= same
        found[x] |= same.any()
    return found


def links_of_bucket(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray | None, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (x, y) that with the parts have the components of all pairs of non-empty sets at `similarity` or more; with `side`, of pairs across sides.

    A pair of one part, or that earlier links have joined, is not compared.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    label = np.unique(part, return_inverse=True)[1]
    held = np.zeros(int(codes.max()) + 1, bool)
    for x in range(len(sets) - 1):
        later = slice(x + 1, None)
        todo = (label[later] != label[x]) & (np.minimum(sizes[later], sizes[x]) / np.maximum(sizes[later], sizes[x]) >= similarity)
        if side is not None:
            todo &= side[later] != side[x]
        if not todo.any():
            continue
        own = codes[ends[x] - sizes[x] : ends[x]]
        held[own] = True
        common = np.bincount(owner[ends[x] :][held[codes[ends[x] :]]], minlength=len(sets))[later]
        held[own] = False
        near = np.flatnonzero(todo & (common / (sizes[later] + sizes[x] - common) >= similarity)) + x + 1
        if len(near):
            label[np.isin(label, label[near])] = label[x]
            for y in near.tolist():
                yield x, y


def _set(text: str | None, shingle: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of a text's shingles, and the hash of them that names the set."""
    found = np.unique(shingle_hashes(text, shingle))
    return found, xxhash.xxh64_intdigest(found.tobytes())


def minhashes(found: list[np.ndarray]) -> np.ndarray:
    """MinHash values of each set."""
    return np.array([minima(x) for x in found]).reshape(len(found), -1)


def signed_rows(docs: DataFrame, text_col: str, keep: list[str], shingle: int, signer: Callable[[list[np.ndarray]], np.ndarray] = minhashes, simhash: bool = False) -> DataFrame:
    """Each row's `keep` with node (its set's hash), n (its size), bands of its signature, none for an empty set, a sketch: the signature's low bytes, and fp: with `simhash` the set's SimHash, else null."""
    names = [f"o{i}" for i in range(len(keep))]
    rows = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(name) for name, c in zip(names, keep)))
    fields = "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for name, c in zip(names, keep))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [_set(t.as_py(), shingle) for t in part.column(0)]
                least = signer([found for found, _ in sets])
                keys = [bands(x) if len(found) else np.empty(0, np.int64) for x, (found, _) in zip(least, sets)]
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
                node = pa.array(np.array([name for _, name in sets], np.uint64).view(np.int64))
                sizes = pa.array([len(found) for found, _ in sets], pa.int64())
                sketches = pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary())
                fps = pa.array([int(np.uint64(majority(found)).view(np.int64)) if simhash else None for found, _ in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([node, sizes, listed, sketches, fps, *part.columns[1:]], ["node", "n", "bands", "sketch", "fp", *names])

    out = rows.mapInArrow(signed, "node long, n long, bands array<bigint>, sketch binary, fp long" + fields)
    return out.select("node", "n", "bands", "sketch", "fp", *(F.col(x).alias(c) for x, c in zip(names, keep)))


def shingle_sets(docs: DataFrame, text_col: str, order: list[str], shingle: int) -> DataFrame:
    """One row for each distinct shingle set: node, least `order` as m, size n, bands, a sketch of MinHash values' bytes and its SimHash fp."""
    return signed_rows(docs, text_col, order, shingle, simhash=True).groupBy("node").agg(F.min(F.struct(*order)).alias("m"), *(F.first(c).alias(c) for c in ("n", "bands", "sketch", "fp")))


#: Rows of ids that are sent to where the texts are; beyond, both are shuffled.
SENT = 1 << 20


def sent(wanted: DataFrame) -> DataFrame:
    """A table of ids and hashes, under 64 bytes a row, marked to be sent to all tasks while it has `SENT` rows at most."""
    kept = cut(wanted)
    return F.broadcast(kept) if kept.count() <= SENT else kept


def hash_sets(texts: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, hashes) of each text's shingle set."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [_set(t.as_py(), shingle) for t in batch.column(0).slice(at, 64)]
                values = np.concatenate([np.empty(0, np.uint64), *(s for s, _ in found)]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s) for s, _ in found)]), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([k for _, k in found], np.uint64).view(np.int64)), lists], ["node", "hashes"])

    return texts.select(text_col).mapInArrow(hashed, "node long, hashes array<bigint>")


def _by_group(rows: DataFrame, payload: str, judge, schema: str) -> DataFrame:
    """What `judge(group, nodes, blocks, parts, payloads)` makes of each (key, i, j); no more than one group is held."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])
        for batch in batches:
            key, i, j, *own = (batch.column(k).to_pylist() for k in range(6))
            for row, new in enumerate(zip(key, i, j)):
                if new != group:
                    if len(held[0]) > 1:
                        yield judge(group, *held)
                    group, held = new, ([], [], [], [])
                for values, more in zip(held, own):
                    values.append(more[row])
                value = batch.column(6)[row]
                held[3].append(value.values.to_numpy().view(np.uint64) if isinstance(value, pa.ListScalar) else value.as_py())
        if len(held[0]) > 1:
            yield judge(group, *held)

    dealt = rows.select("key", "i", "j", "node", "block", "part", payload).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, schema)


def bucket_members(distinct: DataFrame) -> DataFrame:
    """(key, node, n, members) of each set in each of its buckets that has another set."""
    keyed = distinct.select("node", "n", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return keyed.join(several, "key")


def hub_pairs(shared: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each set with the hub of each of its buckets, where sizes and sketches allow the similarity.

    The hub is the bucket's set with the most neighbours over all buckets: the text that near copies were made from
    shares more of their bands than they share with each other.
    """
    degree = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    hubs = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", F.col("node").alias("b"), F.col("n").alias("nb"))).alias("hub")).select("key", "hub.b", "hub.nb")
    fits = (F.col("node") != F.col("b")) & (F.least("n", "nb") >= F.greatest("n", "nb") * (similarity - 1e-9))
    pairs = shared.join(hubs, "key").where(fits).select(F.col("node").alias("a"), "b").distinct()
    sketches = distinct.select("node", "sketch")
    both = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                stay = pa.array(likely((x == y).sum(axis=1), similarity))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(stay), batch.column(1).filter(stay)], ["a", "b"])

    return both.mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, and more columns) whose sets have a Jaccard of `similarity` or more; a hub's many pairs are a skewed join, which Spark splits."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= similarity).select(*pairs.columns)


def parts_of(star: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) to hubs: a hub is its own part, every other node is of the least hub that it is linked to."""
    ends = star.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.bool_or(F.col("root") == F.col("node")).alias("hub"), F.min("root").alias("root")).select("node", F.when(F.col("hub"), F.col("node")).otherwise(F.col("root")).alias("root"))


def in_blocks(parts: DataFrame) -> DataFrame:
    """(key, i, j, node, block, part) of buckets' sets (key, node, n, part), in pairs of blocks.

    A bucket's parts are dealt into blocks of about `BLOCK` hashes, a larger part into several of its own, and blocks meet
    in pairs unless both are of one part; so no task holds more than two blocks, and what one part holds is never
    compared with itself.
    """
    masses = parts.groupBy("key", "part").agg(F.sum("n").alias("mass"))
    large = F.col("mass") > BLOCK
    several = masses.groupBy("key").agg(F.coalesce(F.sum(F.when(~large, F.col("mass"))), F.lit(0)).alias("rest"))
    owned = masses.join(several, "key").select("key", "part", F.when(large, F.col("part")).alias("own"), F.ceil(F.when(large, F.col("mass")).otherwise(F.col("rest")) / BLOCK).alias("blocks"))
    spot = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("part")).otherwise(F.col("node"))), F.col("blocks"))
    placed = parts.join(owned, ["key", "part"]).select("key", "node", "part", "own", F.xxhash64("own", spot).alias("block"))
    blocks = placed.select("key", "own", "block").distinct()
    left, right = blocks.toDF("key", "own_i", "i"), blocks.toDF("key", "own_j", "j")
    meet = left.join(right, "key").where((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("own_i") == F.col("own_j"), F.lit(False)))
    meet = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return placed.join(meet, ["key", "block"]).select("key", "node", "part", "i", "j", "block")


def candidates(shared: DataFrame, roots: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(key, i, j, node, block, part) of sets whose bucket has one of another part that may be near.

    A part is a hub with sets that are linked to it. A bucket of `BLOCK` hashes at most is one block; the parts of a larger
    one are dealt out by `in_blocks`.
    """
    parts = shared.join(roots.withColumnRenamed("root", "part"), "node", "left").select("key", "node", "n", F.coalesce("part", "node").alias("part"))
    buckets = cut(parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum("n").alias("total")).where("low < high").select("key", "total"))
    zero = F.lit(0).cast("long")
    pairs = parts.join(buckets.where(F.col("total") <= BLOCK).select("key"), "key").select("key", "node", "part", zero.alias("i"), zero.alias("j"), zero.alias("block"))
    large = buckets.where(F.col("total") > BLOCK).select("key")
    if not large.isEmpty():
        pairs = pairs.unionByName(in_blocks(parts.join(large, "key")))

    def judge(group, nodes, blocks, parts, sketches):
        found = alike(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), -1), np.array(parts), None if group[1] == group[2] else np.array(blocks), group[0] & 31, similarity)
        at = np.flatnonzero(found)
        same = [pa.array(np.full(len(at), x, np.int64)) for x in group]
        return pa.RecordBatch.from_arrays([*same, *(pa.array(np.array(x, np.int64)[at]) for x in (nodes, blocks, parts))], ["key", "i", "j", "node", "block", "part"])

    return _by_group(pairs.join(distinct.select("node", "sketch"), "node"), "sketch", judge, "key long, i long, j long, node long, block long, part long")


def links_between_parts(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links between nodes whose components, with the parts, are those of all pairs in a group of `near` at `similarity` or more."""

    def judge(group, nodes, blocks, parts, hashes):
        links = list(links_of_bucket(hashes, np.array(parts), None if group[1] == group[2] else np.array(blocks), similarity))
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], ["a", "b"])

    return _by_group(near.join(sets, "node"), "hashes", judge, "a long, b long")


def anchor_pairs(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): sets of one SimHash with its least set, and links of least sets that hold together what anchors find within `threshold` bits."""
    full = distinct.where("n > 0").select("node", "fp")
    least = cut(full.groupBy("fp").agg(F.min("node").alias("least")))
    same = full.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    links = anchor_links(least, threshold).distinct()
    across = links.join(least.toDF("a", "la"), "a").join(least.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return same.union(across)


def near_links(distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, more: DataFrame | None = None) -> DataFrame:
    """(a, b) links whose components are those of all pairs of `distinct` (node, n, bands, sketch) that share a band and have the similarity.

    First every set meets the hubs of its buckets, then only sets of different parts of a bucket meet. A group of copies
    of one text costs what its size is. Sets of a bucket that are near neither its hub nor each other are still compared
    by their sketches, in blocks. `sets_of` gives (node, hashes) for a table of nodes. `more` candidates (a, b) are
    judged with the hubs' pairs, but make no hubs.
    """
    shared = cut(bucket_members(distinct))
    pairs = hub_pairs(shared, distinct, similarity).withColumn("hub", F.lit(True))
    if more is not None:
        pairs = pairs.union(more.select("a", "b", F.lit(False)))
    pairs = cut(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    star = cut(verified(pairs, sets_of(nodes), similarity))
    near = cut(candidates(shared, parts_of(star.where("hub")), distinct, similarity))
    return star.select("a", "b").union(links_between_parts(near, sets_of(near.select("node").distinct()), similarity))


def first_of_near_copies(docs: DataFrame, order: list[str], text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`order` of the least row of each group that links of `similarity` or more between shingle sets hold together.

    `order` tells texts apart and has no nulls; rows that repeat it are one. Texts of fewer words than a shingle are one
    shingle; null and blank texts are one group. Candidates come from SimHash anchors and from MinHash bands; an exact
    check follows. Equality of shingles and of sets is that of 64-bit hashes.
    """
    distinct = cut(shingle_sets(docs, text_col, order, shingle))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = sent(distinct.join(nodes, "node", "left_semi").select("m.*"))
        return hash_sets(docs.join(wanted, order, "left_semi"), text_col, shingle).dropDuplicates(["node"])

    roots = connected_components(near_links(distinct, sets_of, similarity, anchor_pairs(distinct)))
    rooted = distinct.select("node", "m").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("m").alias("m"))
    return rooted.select("m.*")
