"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared by pruned Jaccard.

Built from DataFrame functions, but for the order in which the similarity join takes signatures. A text's words are its runs of letters and digits, lower-cased. Common words
are anchors; all others are content. An anchor and the next `chain` content words after it make a signature, kept
as its 32-bit hash; the fingerprint is the sorted set of signatures.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, null_to_empty
from gleaner.llm.components import connected_components

#: Common words of English, German, French and Spanish: fixed values.
ANCHORS = tuple(
    """a an and are as at be by for from has he in is it its of on or that the this to was were will with
    au auf aus aux bei das dass de del dem den der des die du ein eine einer el elle en er es est et für ich il ist
    la las le les los mit nicht ou para pas por pour que qui se sich sie sont su sur un una und une von y zu""".split()
)


def add_signatures(docs: DataFrame, text_col: str, out: str, chain: int = 2, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """All columns with `out` added: the sorted array<int> of distinct signatures of a text; null counts as empty.

    Chains stop at the end of the text, so the last ones are shorter. A text with words but without an anchor
    has one signature, of all its words; a text without words has none. Words, content words and places of anchors
    are columns of their own: inside the lambda over the places they are read, not computed again.
    """
    kept = [c for c in docs.columns if c != out]
    words = F.filter(F.split(F.lower(null_to_empty(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at = F.array_compact(F.transform("__words", lambda w, i: F.when(w.isin(*anchors), i)))
    # the k-th anchor stands at word i, so i - k content words come before it
    spots = F.transform("__at", lambda i, k: F.hash(F.get("__words", i), *(F.get("__content", i - k + j) for j in range(chain))))
    whole = F.when(F.size("__words") > 0, F.array(F.hash(F.array_join("__words", " ")))).otherwise(F.array().cast("array<int>"))
    parted = docs.select(*kept, words.alias("__words")).withColumns({"__content": F.filter("__words", lambda w: ~w.isin(*anchors)), "__at": at})
    return parted.select(*kept, F.array_sort(F.array_distinct(F.when(F.size("__at") > 0, spots).otherwise(whole))).alias(out))


def as_text(signature: Column) -> Column:
    """Eight hex digits for each signature, in order."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets, 0 to 1; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(docs: DataFrame, id_col: str, text_col: str, out: str, buckets: int | None = None) -> DataFrame:
    """id_col and text_col with `out`: the text of the next row by descending id; after the last that of the first.

    Ids are cut into ranges at approximate quantiles; one shuffle deals rows out by range, and within a range the
    next row is a window function. The last row of a range takes the first of the next range that has rows, from a
    table of one row for each range, which meets the ranges where they are. Rows of equal id come by the hash of
    their texts, null ids last; a null text is carried as null. An id that fills whole ranges, and null ids, are cut
    further by that hash. Ids are numbers, dates or times.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("id", [(i + 1) / buckets for i in range(buckets - 1)], 10 * buckets).alias("b")).first().b or []
    bounds = F.array(*(F.lit(b) for b in dict.fromkeys(cuts))).cast(f"array<{rows.schema['id'].dataType.simpleString()}>")
    # the number of bounds at or above the id: higher ids come first, null ids last
    bucket = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bounds, lambda b: b >= F.col("id"))))
    hot = [b for b, n in Counter(cuts).items() if n > 1]
    part = F.when(F.col("id").isNull() | F.col("id").isin(hot), 31 - F.shiftright("tie", 58)).otherwise(64)  # ties descend, as the window's order does
    placed = rows.select("id", "text", bucket.alias("range"), F.xxhash64("text").alias("tie")).withColumn("bucket", F.col("range") * 128 + part).drop("range")
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("id"), F.desc("tie"))
    led = placed.select("bucket", "id", "text", F.lead(F.struct("text")).over(w).alias("after"))
    key = F.struct(F.col("id").isNotNull(), "id", "tie")
    firsts = placed.groupBy("bucket").agg(F.max(key).alias("k")).select("bucket", F.col("k.id").alias("id"), F.col("k.tie").alias("tie"))
    around = Window.orderBy("bucket")  # one row for each range, of numbers alone
    nexts = firsts.select(F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"), "id", "tie")
    heads = placed.select("id", "text", "tie").join(F.broadcast(nexts.withColumnRenamed("id", "i").withColumnRenamed("tie", "t")), F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    heads = heads.groupBy("bucket").agg(F.first(F.struct("text")).alias("head"))
    joined = led.join(heads, "bucket", "left")
    return joined.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.coalesce("after", "head").getField("text").alias(out))


#: Numbers that signatures are counted under, and sets that a task orders at once: fixed values.
COUNTERS, ORDERED = 1 << 18, 256


def _rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """(c, len, x): the first n - ceil(t n) + 1 signatures of each set (c, s) in one order of all signatures, rare ones first.

    Signatures are counted by their last bits, so the table of counts, which goes to all tasks, has one size however
    many signatures there are. Signatures of one number count together: that changes which come first, not what is found,
    as any order that all sets share gives the same links.
    """
    spark = sets.sparkSession
    counted = sets.select(F.explode("s").alias("x")).groupBy(F.col("x").bitwiseAND(COUNTERS - 1).alias("h")).count().toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted["h"].to_numpy()] = counted["count"].to_numpy()
    sent = spark.sparkContext.broadcast(counts)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ORDERED):
                part = batch.slice(at, ORDERED)
                n, x = np.asarray(part["s"].value_lengths()), part["s"].flatten().to_numpy()
                row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                order = np.lexsort((x, sent.value[x & (COUNTERS - 1)], row))
                first = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
                kept = order[np.arange(len(x)) - start[row] < first[row]]
                own = row[kept]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part["c"])[own]), pa.array(n[own].astype(np.int32)), pa.array(x[kept])], ["c", "len", "x"])

    return sets.select("c", "s").mapInArrow(take, "c long, len int, x int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """(doc_id, component_id): texts whose signature sets have a Jaccard of `threshold` or more are linked.

    One row for each input row. Equal sets are one class first, all empty sets among them. Sets are partitioned by
    length: lengths grow by 1/threshold from one class of lengths to the next, so a pair is in one or two neighbouring
    classes. Within a class sets meet only in one of their rarest signatures, of which the longer set must share one
    of its first n - ceil(t n) + 1; most of these are in no other set, and are dropped at once. component_id is the smallest id reachable; null ids count only among themselves. Ids are cast to long.

    A signature that many near copies share would make all their pairs. So each bucket's sets are first compared with
    one of them, and linked sets become one part; then only sets of different parts of a bucket are compared. A group
    of mutual near copies costs what its size is, and no link between parts is lost. Sets travel only to pairs.
    """
    rows = cut(add_signatures(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "s", chain).select("doc_id", F.xxhash64("s").alias("c"), "s"))
    classes = cut(rows.groupBy("c").agg(F.min("doc_id").alias("least"), F.first("s").alias("s")))
    sets = classes.where(F.size("s") > 0).select("c", "s")
    keyed = _rarest(sets, threshold).withColumn("n", F.count("*").over(Window.partitionBy("x"))).where("n > 1")
    own = F.floor(F.log("len") / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    met = cut(keyed.select("c", "len", "x", own.alias("own"), F.explode(F.array(own, own + 1)).alias("k")))

    def alike(pairs: DataFrame) -> DataFrame:
        a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        return cut(pairs.distinct().join(a, "a").join(b, "b").where(jaccard(F.col("sa"), F.col("sb")) >= threshold - 1e-12).select("a", "b"))

    near = F.least("la", "lb") >= F.greatest("la", "lb") * threshold - 1e-9
    first = met.where("own = k").groupBy("x", "k").agg(F.min(F.struct(F.col("c").alias("b"), F.col("len").alias("lb"))).alias("r"))
    star = alike(met.join(first.select("x", "k", "r.*"), ["x", "k"]).where("c <> b").withColumn("la", F.col("len")).where(near).select(F.col("c").alias("a"), "b"))
    part = connected_components(star)
    parts = cut(met.join(part, F.col("c") == F.col("node"), "left").select("x", "k", "c", "len", (F.col("own") == F.col("k")).alias("here"), F.coalesce("root", "c").alias("part")))
    several = parts.groupBy("x", "k").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("x", "k")
    present = parts.join(several, ["x", "k"]).select("x", "k", "part").distinct()
    across = present.withColumnRenamed("part", "pa").join(present.withColumnRenamed("part", "pb"), ["x", "k"]).where("pa < pb")
    left, right = parts.toDF("x", "k", "a", "la", "ha", "pa"), parts.toDF("x", "k", "b", "lb", "hb", "pb")
    rest = across.join(left, ["x", "k", "pa"]).join(right, ["x", "k", "pb"]).where((F.col("ha") | F.col("hb")) & near)
    links = star.union(alike(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    rooted = classes.join(connected_components(links), F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("c", "component_id")
    return rows.select("doc_id", "c").join(named, "c").select("doc_id", "component_id")
