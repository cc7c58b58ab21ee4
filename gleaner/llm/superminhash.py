"""SuperMinHash near copies: correlated permutation ranks, banding, exact verification, union-find grouping.

Each element of a set draws a random permutation of the signature's places, a step at a time. At step j it offers j plus
a random fraction to the place that its permutation names, and a place keeps the least offer. So an element gives every
place another rank, which lowers the variance of the estimate, and once each place holds less than j + 1 no later step
can change anything: large sets stop after one or two steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import nearcopies
from gleaner.llm.common import cut
from gleaner.llm.components import connected_components

#: Elements whose permutations are held at once; step and factors that mix element hashes, fixed values.
ELEMENTS_AT_ONCE = 1 << 17
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _drawn(x: np.ndarray, j: int) -> np.ndarray:
    """64 random bits for each element and step."""
    z = x + np.uint64(int(STEP) * (j + 1) % (1 << 64))
    for shift, factor in zip((30, 27), MIX):
        z = (z ^ (z >> np.uint64(shift))) * factor
    return z ^ (z >> np.uint64(31))


def _signed(x: np.ndarray, owner: np.ndarray, sets: int, places: int) -> np.ndarray:
    """Signatures of the sets that own the elements x; a set without elements keeps the greatest number in each place."""
    least = np.full(sets * places, np.iinfo(np.uint64).max, np.uint64)
    done = np.bincount(owner, minlength=sets) == 0
    order = np.tile(np.arange(places, dtype=np.uint8), (len(x), 1))
    for j in range(places):
        bits = _drawn(x, j)
        k = j + (((bits & LOW) * np.uint64(places - j)) >> HALF).astype(np.int64)
        at = np.arange(len(x))
        place = order[at, k].astype(np.int64)
        order[at, k] = order[:, j]  # a swap whose other half is never read again
        np.minimum.at(least, owner * places + place, (np.uint64(j) << HALF) | (bits >> HALF))
        done |= least.reshape(sets, places).max(axis=1) < np.uint64(j + 1) << HALF
        if done.all():
            break
        live = ~done[owner]
        if 4 * live.sum() < 3 * len(live):
            x, owner, order = x[live], owner[live], order[live]
    return least.reshape(sets, places)


def signatures(found: list[np.ndarray], places: int = nearcopies.BANDS * nearcopies.ROWS) -> np.ndarray:
    """One row of `places` (256 at most) values for each set of element hashes: step << 32 | random fraction.

    Two sets agree in a place with a probability of their Jaccard similarity. A set of any size is signed in parts,
    whose least values are the whole's, in bounded memory.
    """
    out = np.full((len(found), places), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    low = 0
    while low < len(found):
        high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), ELEMENTS_AT_ONCE, "right")) + low)
        x, owner = np.concatenate(found[low:high]), np.repeat(np.arange(high - low), sizes[low:high])
        for at in range(0, len(x), ELEMENTS_AT_ONCE):
            part = slice(at, at + ELEMENTS_AT_ONCE)
            np.minimum(out[low:high], _signed(x[part], owner[part], high - low, places), out=out[low:high])
        low = high
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: sets of word shingles with a Jaccard of `similarity` or more are linked.

    A-Z is lower-cased; words are runs of other than white space. n_shingles is the size of the set; a text of fewer
    words than a shingle is one shingle; null, empty and blank texts have an empty set and are linked with nothing.
    component_id is the least id reachable, the row's own included; kept tells whether it is the row's own. Equal sets
    are one node, so copies are never compared. Candidates share a band of the signature (24 of 4 places: a pair of
    similarity 0.8 has none with probability 3.2e-6); every link is confirmed on the full sets, told by 64-bit hashes.
    Repeated rows each give a row; a null id is its component's only where no row of it has an id. Ids are
    cast to long. Other columns are not read; a table without rows gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    signed = cut(nearcopies.signed_rows(rows, "text", ["doc_id", "mark"], shingle, signatures))
    full = signed.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("m")
    distinct = cut(full.groupBy("node").agg(least, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = nearcopies.sent(distinct.join(nodes, "node", "left_semi").select(F.col("m.mark").alias("mark"), F.col("m.doc_id").alias("i")))
        texts = rows.join(wanted, (rows.mark == wanted.mark) & rows.doc_id.eqNullSafe(wanted.i), "left_semi").dropDuplicates(["doc_id", "mark"])
        return nearcopies.hash_sets(texts, "text", shingle)

    roots = connected_components(nearcopies.near_links(distinct, sets_of, similarity))
    rooted = cut(distinct.select("node", "m").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "m.doc_id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id")
    linked = full.select("doc_id", "node", "n").join(named, "node").select("doc_id", "n", "component_id")
    alone = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
