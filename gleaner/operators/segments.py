"""A stored inverted index in segments: a change writes what changed, and small segments are merged.

A segment is an immutable folder of Parquet tables over some records. A revision of the index, a small file that is
renamed into place, names the segments that make it up, the rows of theirs that are dead (replaced or removed records),
and the number of records of each language and category. So readers always see a whole revision, and an update writes
the new rows, a list of dead ones and a revision. Segments of one size class are merged once there are `FAN` of them, so
each row is rewritten a number of times that grows as the logarithm of the index, and so is a segment that is half dead.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as X
from gleaner.operators.versions import Versions
from gleaner.storage import sent

CHUNK_COLUMNS = ("chunk_id", "source_id", "title", "canonical_url", "category", "language", "content", "checksum")
TABLES = ("chunks", "postings", "doc_tokens", "vocabulary", "grams", "sources")
FAN = 4
#: What of a record its rows in the index are made from.
_DIGESTED = ("title", "canonical_url", "category", "language", "content", "checksum")


@dataclass(frozen=True)
class Index:
    """The tables of one revision. Postings and doc_tokens may hold rows of dead records: `live` leaves them out after a look-up.

    A record that is one chunk has its tokens in that chunk's postings; own_tokens has those of records that were cut.
    """

    chunks: DataFrame
    postings: DataFrame
    own_tokens: DataFrame
    vocabulary: DataFrame
    grams: DataFrame
    sources: DataFrame
    totals: DataFrame
    dead: DataFrame | None = None

    @property
    def doc_tokens(self) -> DataFrame:
        """(language, category, source_id, token, segment): each token of each record once."""
        return self.postings.where("whole").select("language", "category", "source_id", "token", "segment").unionByName(self.own_tokens)

    @property
    def placeholders(self) -> DataFrame:
        """source_id of short records with a placeholder notice."""
        return self.sources.where("thin").select("source_id")

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (with segment and source_id) of records that are not dead."""
        return rows if self.dead is None else rows.join(self.dead, ["segment", "source_id"], "left_anti")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        return _opened(spark, folder, _Revisions(spark, folder).latest())


class _Revisions(Versions):
    """The revisions of an index folder."""

    def latest(self) -> dict:
        known = self._revisions()
        return self._read(f"revision-{known[-1]}.json") if known else {"revision": 0, "segments": [], "dead": None, "totals": None, "mark": None}

    def add(self, state: dict) -> dict:
        """The next revision; Conflict if another writer was faster."""
        new = state | {"revision": state["revision"] + 1}
        self._create(f"revision-{new['revision']}.json", new)
        return new

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the folders that none of the last `keep` revisions names; their names."""
        held = [self._read(f"revision-{n}.json") for n in self._revisions()[-keep:]]
        used = {s["name"] for h in held for s in h["segments"]} | {h[k] for h in held for k in ("dead", "totals") if h[k]}
        gone = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory() and f.getPath().getName() not in used]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone


def _opened(spark: SparkSession, folder: str, state: dict) -> Index:
    names = [s["name"] for s in state["segments"]]
    read = lambda table: reduce(DataFrame.unionByName, (_told(spark.read.parquet(f"{folder}/{n}/{table}"), table).withColumn("segment", F.lit(n)) for n in names))
    found = {t: read(t) for t in TABLES}
    found["own_tokens"] = found.pop("doc_tokens")
    dead = spark.read.parquet(f"{folder}/{state['dead']}") if state["dead"] else None
    if dead is not None:
        for t in ("chunks", "sources"):
            found[t] = found[t].join(dead, ["segment", "source_id"], "left_anti")
    for t in ("vocabulary", "grams"):
        found[t] = found[t].drop("segment")
    return Index(**found, totals=spark.read.parquet(f"{folder}/{state['totals']}"), dead=dead)


def _told(rows: DataFrame, table: str) -> DataFrame:
    """rows of a segment's table; older segments have the tokens of all records in doc_tokens, and their postings tell no category."""
    if table == "postings" and "whole" not in rows.columns:
        return rows.withColumns({"category": F.lit(None).cast("string"), "whole": F.lit(False)})
    return rows


def grams_of(token: Column) -> Column:
    """The distinct runs of three characters of a token of three or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, F.lit(3))))


def trigrams(vocabulary: DataFrame) -> DataFrame:
    """(language, gram, token, is_key) of tokens of five characters or more: the key is one of a token's grams, that of least hash."""
    own = vocabulary.where(F.length("token") >= 5).select("language", "token", grams_of(F.col("token")).alias("g"))
    key = F.array_min(F.transform("g", lambda x: F.named_struct(F.lit("hash"), F.xxhash64(x), F.lit("gram"), x)))["gram"]
    each = own.select("language", "token", key.alias("key"), F.explode("g").alias("gram"))
    return each.select("language", "gram", "token", (F.col("gram") == F.col("key")).alias("is_key"))


def _tables(records: DataFrame, chunks: DataFrame, folder: str) -> None:
    """Writes a segment's tables from records and their chunks. Each text is tokenized once, with its chunk."""
    spark = records.sparkSession
    split = chunks.select(*CHUNK_COLUMNS, X.terms(F.col("title")).alias("title_terms"), F.array_distinct(X.terms(F.col("content"))).alias("body_terms"))
    split.write.parquet(f"{folder}/chunks")
    tokenized = spark.read.parquet(f"{folder}/chunks")
    # the body's tokens come first in the union, so a token's place tells whether it is one of them
    token = F.posexplode(F.array_union("body_terms", F.array_distinct("title_terms"))).alias("place", "token")
    # a record that is one chunk has that chunk's tokens; others may have been cut within a word. No text is shuffled to tell
    key = ["source_id", "checksum"]
    made = tokenized.select(*key).distinct().withColumn("made", F.lit(True))
    odd = records.select(*key).distinct().withColumn("given", F.lit(True)).join(made, key, "full").where("given IS NULL OR made IS NULL")
    odd.write.parquet(f"{folder}/odd")
    odd = spark.read.parquet(f"{folder}/odd")
    all_whole = odd.isEmpty()
    flagged = tokenized.withColumn("whole", F.lit(True))
    if not all_whole:
        flagged = tokenized.join(odd.where("made").select(*key, F.lit(False).alias("whole")), key, "left").withColumn("whole", F.coalesce("whole", F.col("source_id").isNotNull() & F.col("checksum").isNotNull()))
    post = flagged.select("language", "category", "chunk_id", "source_id", "whole", F.size("body_terms").alias("n"), "title_terms", token)
    post = post.select("language", "token", "chunk_id", "source_id", "category", (F.col("place") < F.col("n")).alias("in_body"), F.array_contains("title_terms", F.col("token")).alias("in_title"), "whole")
    _by_token(post).write.parquet(f"{folder}/postings")
    if all_whole:
        spark.createDataFrame([], "language string, category string, source_id string, token string").write.parquet(f"{folder}/doc_tokens")
    else:
        given = odd.where("given").select(F.col("source_id").alias("s"), F.col("checksum").alias("c"))
        parted = records.join(given, F.col("source_id").eqNullSafe(F.col("s")) & F.col("checksum").eqNullSafe(F.col("c")), "left_semi")
        tokens = parted.select("language", "category", "source_id", F.explode(F.array_distinct(X.terms(F.concat_ws(" ", "title", "content")))).alias("token"))
        _by_token(tokens).write.parquet(f"{folder}/doc_tokens")
    thin = F.coalesce(X.matches(F.col("content"), config.PLACEHOLDER_NOTICE) & (X.word_count(F.col("content")) <= 80), F.lit(False))
    records.select("source_id", "language", "category", _digest(), thin.alias("thin")).write.parquet(f"{folder}/sources")
    _words(spark, folder)


def _by_token(rows: DataFrame) -> DataFrame:
    """Each token in one file, where rows are in order of tokens, so that a look-up reads few row groups; Spark splits a word that all texts have over files."""
    return rows.hint("rebalance", "language", "token").sortWithinPartitions("language", "token")


def _words(spark: SparkSession, folder: str) -> None:
    held = spark.read.parquet(f"{folder}/postings").where("whole").select("language", "token")
    held.unionByName(spark.read.parquet(f"{folder}/doc_tokens").select("language", "token")).distinct().write.parquet(f"{folder}/vocabulary")
    trigrams(spark.read.parquet(f"{folder}/vocabulary")).sortWithinPartitions("language", "gram").write.parquet(f"{folder}/grams")


def _digest() -> Column:
    return F.xxhash64(*_DIGESTED).alias("digest")


def _finished(revisions: _Revisions, state: dict, sources: DataFrame, mark: dict | None) -> dict:
    """The revision of `state` with totals of its live sources."""
    totals = f"totals-{uuid.uuid4().hex}"
    sources.groupBy("language", "category").agg(F.count("*").alias("n_documents")).coalesce(1).write.parquet(f"{revisions.root}/{totals}")
    return revisions.add(state | {"totals": totals, "mark": mark})


def update(records: DataFrame, folder: str, cut, mark: dict | None = None) -> dict:
    """Brings an index to exactly `records`: new and changed ones make a segment, changed and removed ones die. The revision.

    cut(records) gives the chunks (CHUNK_COLUMNS) of records. mark is kept with the revision. Only the sources'
    digests are compared with the records; no text or posting of what stays is read or written.
    """
    spark = records.sparkSession
    revisions = _Revisions(spark, folder)
    state = revisions.latest()
    dead = spark.read.parquet(f"{folder}/{state['dead']}") if state["dead"] else None
    name, new = f"segment-{uuid.uuid4().hex}", records
    if state["segments"]:
        known = _opened(spark, folder, state).sources
        _changed(records, known).write.parquet(f"{folder}/{name}/records")
        new = spark.read.parquet(f"{folder}/{name}/records")
        gone = known.join(records.select("source_id", _digest()), ["source_id", "digest"], "left_anti").select("segment", "source_id")
        dead = gone if dead is None else dead.unionByName(gone)
    segments = list(state["segments"])
    if not new.isEmpty():
        _tables(new, cut(new), f"{folder}/{name}")
        segments.append({"name": name, "rows": spark.read.parquet(f"{folder}/{name}/sources").count()})
    listed = None
    if dead is not None:
        listed = f"dead-{uuid.uuid4().hex}"
        dead.coalesce(8).write.parquet(f"{folder}/{listed}")
        if spark.read.parquet(f"{folder}/{listed}").isEmpty():
            listed = None
    for scratch in ("records", "odd"):
        revisions._fs.delete(revisions._path(f"{folder}/{name}/{scratch}"), True)
    if not segments:
        raise ValueError("an index needs a record")
    now = state | {"segments": segments, "dead": listed}
    sources = reduce(DataFrame.unionByName, (spark.read.parquet(f"{folder}/{s['name']}/sources").withColumn("segment", F.lit(s["name"])) for s in segments))
    if listed:
        sources = sources.join(spark.read.parquet(f"{folder}/{listed}"), ["segment", "source_id"], "left_anti")
    state = _finished(revisions, now, sources, mark)
    while due := _due(spark, folder, state):
        state = merge(spark, folder, due)
    return state


def _changed(records: DataFrame, known: DataFrame) -> DataFrame:
    """The records whose source or digest the index doesn't have."""
    fresh = records.select("source_id", _digest()).join(known.select("source_id", "digest"), ["source_id", "digest"], "left_anti").distinct().toDF("s", "d")
    return records.join(sent(fresh), F.col("source_id").eqNullSafe(F.col("s")) & (_digest() == F.col("d")), "left_semi")


def size_class(rows: int) -> int:
    return int(log(max(rows, 1), FAN) + 1e-9)


def _due(spark: SparkSession, folder: str, state: dict) -> list[str]:
    """Names of segments to merge: FAN or more of one size class, or one that is half dead."""
    lost = {}
    if state["dead"]:
        lost = {r.segment: r.n for r in spark.read.parquet(f"{folder}/{state['dead']}").groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each segment
    by_class: dict[int, list[str]] = {}
    for s in state["segments"]:
        if 2 * lost.get(s["name"], 0) > s["rows"]:
            return [s["name"]]
        by_class.setdefault(size_class(s["rows"] - lost.get(s["name"], 0)), []).append(s["name"])
    return next((names for _, names in sorted(by_class.items()) if len(names) >= FAN), [])


def merge(spark: SparkSession, folder: str, names: list[str]) -> dict:
    """Rewrites segments as one without their dead rows; the revision. No text is tokenized again."""
    revisions = _Revisions(spark, folder)
    state = revisions.latest()
    part = _opened(spark, folder, state | {"segments": [s for s in state["segments"] if s["name"] in names]})
    name = f"segment-{uuid.uuid4().hex}"
    part.sources.drop("segment").write.parquet(f"{folder}/{name}/sources")
    rows = spark.read.parquet(f"{folder}/{name}/sources").count()
    if rows:
        part.chunks.drop("segment").write.parquet(f"{folder}/{name}/chunks")
        _by_token(part.live(part.postings).drop("segment")).write.parquet(f"{folder}/{name}/postings")
        _by_token(part.live(part.own_tokens).drop("segment")).write.parquet(f"{folder}/{name}/doc_tokens")
        _words(spark, f"{folder}/{name}")
    rest = [s for s in state["segments"] if s["name"] not in names] + ([{"name": name, "rows": rows}] if rows else [])
    listed = None
    if state["dead"]:
        left = spark.read.parquet(f"{folder}/{state['dead']}").where(~F.col("segment").isin(*names))
        if not left.isEmpty():
            listed = f"dead-{uuid.uuid4().hex}"
            left.write.parquet(f"{folder}/{listed}")
    if not rest:
        raise ValueError("an index needs a record")
    return revisions.add(state | {"segments": rest, "dead": listed})


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Removes what only older revisions name; readers of those lose their files."""
    return _Revisions(spark, folder).vacuum(keep)


def mark_of(spark: SparkSession, folder: str) -> dict | None:
    """What the latest revision was marked with; None without an index."""
    return _Revisions(spark, folder).latest()["mark"]
