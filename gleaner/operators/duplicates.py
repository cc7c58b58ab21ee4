"""Exact and near duplicates of records."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.storage import cut


def exact_duplicates(records: DataFrame) -> DataFrame:
    """(source_id, duplicate_of): all but the first by URL of the records of a language that share a checksum.

    The first of each group comes from an aggregate, so a group of any size never meets in one sort.
    """
    first = records.groupBy("language", "checksum").agg(F.min(F.struct("canonical_url", "source_id")).alias("f"), F.count("*").alias("n")).where("n > 1")
    same = records.join(first, ["language", "checksum"])
    return same.where(F.col("source_id") != F.col("f.source_id")).select("source_id", F.col("f.source_id").alias("duplicate_of"))


def first_copies(records: DataFrame) -> DataFrame:
    """Records that are not exact duplicates of an earlier one."""
    first = records.groupBy("language", "checksum").agg(F.min(F.struct("canonical_url", "source_id")).alias("f"))
    return records.join(first.select(F.col("f.source_id").alias("source_id")), "source_id", "left_semi")


#: The earliest rows of a bucket, which all of its rows are compared with first.
HEADS = 4
#: Counters of the token frequencies by which a set's tokens are ordered: tokens that share one only lose rank.
COUNTERS = 1 << 20
#: Bits of a set's sketch, each the parity of the tokens that fall on it.
SKETCH = 1024
#: Rows of class ids that are sent to where the sets are; beyond, both are shuffled.
SENT = 1 << 20


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many tokens of `sets` (t array<bigint>) fall on each counter; a table of one fixed size."""
    counted = sets.select(F.explode("t").alias("t")).groupBy(F.pmod("t", F.lit(COUNTERS)).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    n = np.zeros(COUNTERS, np.int64)
    n[counted["b"].to_numpy()] = counted["n"].to_numpy()
    return n


def _marked(sets: DataFrame, threshold: float) -> DataFrame:
    """(c, canonical_url, source_id, size, head, sketch) of sets (c, canonical_url, source_id, t): the rarest tokens, of which two alike sets share one, and the sketch."""
    frequencies = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = frequencies.value
        for batch in batches:
            heads, sizes, sketches = [], [], []
            for t in batch.column(3):
                own = t.values.to_numpy()
                size = len(own)
                first = np.lexsort((own, n[own % COUNTERS]))[: size - ceil(size * threshold - 1e-9) + 1]
                heads.append(own[first])
                sizes.append(size)
                sketches.append(np.packbits((np.bincount(own & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64))
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), lists(heads), lists(sketches)], ["c", "canonical_url", "source_id", "size", "head", "sketch"])

    return sets.select("c", "canonical_url", "source_id", "t").mapInArrow(mark, "c long, canonical_url string, source_id string, size int, head array<bigint>, sketch array<bigint>")


def similar_pages(records: DataFrame, threshold: float = 0.95, first_words: int | None = None, wordless: bool = False) -> DataFrame:
    """(source_id, similar_to): for each record the earliest by URL whose words are alike by `threshold` or more.

    Compared are the sets of all words (or of the first ones, if a number is given) of records of a language, exact copies
    apart; equal sets are one class, those without words only if `wordless` ones are alike. Two sets as alike as that share one of their rarest tokens: the longer's first n - ceil(t n) + 1 in order
    of corpus frequency; where they first do, enough tokens must follow in both. Any one order of tokens will do, so
    frequencies are those of a table of counters, and only a set's rarest tokens are dealt out. Each class first meets the HEADS
    earliest of each of its tokens. What it is like there bounds what it still has to look for: something earlier. So
    it meets a token's other classes only where some of them are earlier than that; copies of one template, which share all
    their tokens, are done with the heads. Left quadratic are tokens that many unlike sets have among their rarest,
    each with none alike before it. Pairs meet by their sketches, whose bits can't differ in more places than the sets
    do, and sets are fetched for the pairs that are left. Words are told by 64-bit hashes.
    """
    words = X.words(F.col("content"))
    words = words if first_words is None else F.slice(words, 1, first_words)
    hashed = F.array_sort(F.array_distinct(F.transform(words, lambda x: F.xxhash64("language", x))))
    rows = records.where("language IS NOT NULL").select("source_id", "canonical_url", hashed.alias("t"), "language").where(F.size("t") >= (0 if wordless else 1))
    held = cut(rows.select("source_id", "canonical_url", F.xxhash64("language", "t").alias("c"), "t"))
    order = F.struct("canonical_url", "source_id")
    classes = cut(_marked(held, threshold).groupBy("c").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("head").alias("head"), F.first("sketch").alias("sketch")))
    tokens = classes.select("c", "size", "first", F.posexplode("head").alias("place", "t"))
    several = classes.select(F.explode("head").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    keyed = cut(tokens.join(several, "t"))
    # of a pair's first common token at most this many tokens are common from there on
    left_over = F.least(F.col("size") - F.col("place"), F.col("hs") - F.col("hp"))
    likely = (F.col("hf") < F.col("first")) & (F.least("size", "hs") >= F.greatest("size", "hs") * threshold - 1e-9) & (left_over >= (F.col("size") + F.col("hs")) * threshold / (1 + threshold) - 1e-6)
    other = [F.col("c").alias("h"), F.col("size").alias("hs"), F.col("first").alias("hf"), F.col("place").alias("hp")]
    earliest = Window.partitionBy("t").orderBy("first")
    heads = cut(keyed.withColumn("r", F.row_number().over(earliest)).where(F.col("r") <= HEADS))
    sketches = classes.select("c", "size", "sketch")
    differ = F.aggregate(F.zip_with("sketch", "hsketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)

    def alike(pairs: DataFrame) -> DataFrame:
        """(c, f): the earliest first record of the classes that each class is like, of the given pairs."""
        met = pairs.select("c", "h", "hf").distinct().join(sketches, "c").join(sketches.toDF("h", "hs", "hsketch"), "h")
        near = cut(met.where(differ <= (F.col("size") + F.col("hs")) * (1 - threshold) / (1 + threshold) + 1e-6).select("c", "h", "hf"))
        wanted = cut(near.select("c").union(near.select("h")).distinct())
        sent = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        sets = held.select("c", "t").join(sent, "c", "left_semi").dropDuplicates(["c"])
        both = near.join(sets, "c").join(sets.toDF("h", "ht"), "h")
        common = F.size(F.array_intersect("t", "ht"))
        return cut(both.where(common / (F.size("t") + F.size("ht") - common) >= threshold).groupBy("c").agg(F.min("hf").alias("f")))

    near = alike(keyed.join(heads.select("t", *other), "t").where(likely))
    # what is still looked for is earlier than what was found, and later than the heads
    last_head = heads.where(F.col("r") == HEADS).select("t", F.col("first").alias("last"))
    open_ = keyed.join(near, "c", "left").withColumn("bound", F.least(F.coalesce("f", "first"), "first")).join(last_head, "t").where(F.col("last") < F.col("bound"))
    later = keyed.select("t", *other)
    rest = alike(open_.join(later, "t").where((F.col("hf") > F.col("last")) & (F.col("hf") < F.col("bound")) & likely))
    found = near.unionByName(rest).unionByName(classes.select("c", F.col("first").alias("f")))
    best = found.groupBy("c").agg(F.min("f").alias("f"))
    return held.select("source_id", "canonical_url", "c").join(best, "c").where(F.col("f") < order).select("source_id", F.col("f.source_id").alias("similar_to"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def containing(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, words: int = 5) -> DataFrame:
    """(quote_id, n_documents): in how many texts (text_id, text) each quote (quote_id, text) stands as it is.

    A text that has a quote has the quote's inner words in a row. So quotes of `words` inner words meet texts in their
    shingle of inner words whose hash is least, quotes of fewer in their longest inner word, and quotes without an inner
    word in the first three characters of their longest part, which some word of the text must hold (a blank one in
    its first character); what meets is compared as a whole. An empty quote stands in every text, a null one in none.
    """
    gap = r"\s+"
    shingles = lambda c, inner: F.transform(F.sequence(F.lit(0 if not inner else 1), F.size(c) - words - (1 if inner else 0)), lambda i: F.xxhash64(F.array_join(F.slice(c, i + 1, words), " ")))
    split = F.split(F.col("text"), gap)
    q = quotes.where("text <> ''").select(F.col(quote_id), F.col("text").alias("quote"), split.alias("w"))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    longest = lambda c: F.array_max(F.transform(c, lambda x: F.named_struct(F.lit("n"), F.length(x), F.lit("word"), x)))["word"]
    many, some = F.size("w") >= words + 2, F.size("w") > 2
    by_shingle = q.where(many).select(quote_id, F.array_min(shingles(F.col("w"), True)).alias("h"))
    by_word = q.where(~many & some).select(quote_id, longest(inner).alias("word"))
    blank = F.col("quote").rlike(r"^\s+$")
    by_gram = q.where(~some).select(quote_id, F.when(blank, F.left("quote", F.lit(1))).otherwise(F.left(longest(F.col("w")), F.lit(3))).alias("gram"))
    t = texts.select(text_id, split.alias("w"))
    own = t.where(F.size("w") >= words).select(text_id, F.explode(F.array_distinct(shingles(F.col("w"), False))).alias("h"))
    each = t.select(text_id, F.explode(F.array_distinct("w")).alias("word"))
    gaps = texts.select(text_id, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\s)"), 1))).alias("gram"))
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))
    grams = each.select(text_id, F.explode(F.concat(*(F.when(F.length("word") >= n, parts(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)))).alias("gram")).unionByName(gaps)
    met = own.join(by_shingle, "h").select(quote_id, text_id).unionByName(each.join(by_word, "word").select(quote_id, text_id)).unionByName(grams.join(by_gram, "gram").select(quote_id, text_id)).distinct()
    found = met.join(q.select(quote_id, "quote"), quote_id).join(texts.select(text_id, "text"), text_id).where(F.col("text").contains(F.col("quote")))
    counts = quotes.join(found.groupBy(quote_id).agg(F.count("*").alias("n")), quote_id, "left")
    total = texts.agg(F.count("text").alias("__all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(quote_id, F.when(F.col("text") == "", F.col("__all")).otherwise(F.coalesce("n", F.lit(0))).alias("n_documents"))
