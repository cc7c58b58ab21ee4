"""Chunks and the inverted index: postings that answer many questions in one job."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as X
from gleaner.operators import segments
from gleaner.storage import sent

#: Records whose chunks leave a task at once.
RECORDS_AT_ONCE = 64
#: What parts paragraphs, and the characters that parts don't begin or end with (None: all white space): of all white space, and of SQL's.
ALL_SPACE = (r"\n\s*\n", None)
SQL_SPACE = (r"\n[\t\n\f\r ]*\n", " \n\t\r")


def cut_places(text: str, most: int, least: int, space: tuple[str, str | None] = ALL_SPACE) -> Iterator[tuple[int, int]]:
    """[begin, end) of parts of `most` characters at most: paragraphs, the longer ones cut at spaces.

    A scan over the places where a text may break. A part of a long paragraph ends at the last space within reach, if
    that is `least` characters on, else at the limit.
    """
    gap, blank = space
    spaces = [m.start() for m in re.finditer(" ", text)]
    edges = [0, *(x for m in re.finditer(gap, text) for x in m.span()), len(text)]
    for low, high in zip(edges[::2], edges[1::2]):
        high = low + len(text[low:high].rstrip(blank))
        while low < high:
            low += len(text[low:high]) - len(text[low:high].lstrip(blank)) if text[low].isspace() else 0
            end = high
            if high - low > most:
                last = bisect_right(spaces, low + most) - 1
                end = spaces[last] if last >= 0 and spaces[last] - low >= least else low + most
            yield low, low + len(text[low:end].rstrip(blank))
            low = end


def pieces(text: str, most: int = config.CHUNK_CHARS, least: int = config.CHUNK_LEAST, space: tuple[str, str | None] = ALL_SPACE) -> list[str]:
    """The parts of a text between its cut places, those in a row that fit into `most` characters joined by a blank line; a blank text is one empty piece."""
    rows: list[list[str]] = []
    size = most
    for low, high in cut_places(text, most, least, space):
        size += 2 + high - low
        if size > most:
            rows.append([])
            size = high - low
        rows[-1].append(text[low:high])
    return ["\n\n".join(row) for row in rows]


def chunks(records: DataFrame, spans_col: str | None = None, space: tuple[str, str | None] = ALL_SPACE, keep_blank: bool = True) -> DataFrame:
    """Records exploded to chunks: content, checksum and chunk_id `<source_id>--NNN` replaced or added, source_location added.

    spans_col is array<struct<kind,label,start,end>> (end exclusive, code points); without spans the content is one.
    Spans outside the content are passed over, and a record without any piece keeps its content as one chunk, unless
    blank records are not kept.
    """
    spans = F.col(spans_col) if spans_col else F.lit(None).cast("array<struct<kind:string,label:string,start:int,end:int>>")
    rest = [c for c in records.columns if c not in ("content", "checksum", "chunk_id", "source_location", spans_col)]
    inner = records.select(F.struct(*rest).alias("r"), "content", spans.alias("spans"))
    location = "struct<kind:string,label:string>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, RECORDS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, RECORDS_AT_ONCE)):
            rows, texts, numbers, places = [], [], [], []
            for k in range(batch.num_rows):
                content, own = batch.column(1)[k].as_py() or "", batch.column(2)[k].as_py()
                n = 0
                for span in own or [{"start": 0, "end": len(content)}]:
                    start, end = span["start"], span["end"]
                    if start is None or end is None or not 0 <= start < end <= len(content):
                        continue
                    for piece in pieces(content[start:end], space=space):
                        n += 1
                        rows.append(k)
                        texts.append(piece)
                        numbers.append(n)
                        places.append({"kind": span["kind"] or "section", "label": span["label"] or f"Section {n}"} if own else None)
                if not n and keep_blank:
                    rows.append(k)
                    texts.append(content)
                    numbers.append(1)
                    places.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(texts, pa.string()), pa.array(numbers, pa.int32()), pa.array(places, pa.struct([("kind", pa.string()), ("label", pa.string())]))],
                ["r", "content", "number", "source_location"],
            )

    kind = inner.schema["r"].dataType.simpleString()
    out = inner.mapInArrow(cut, f"r {kind}, content string, number int, source_location {location}")
    digits = F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string"))
    return out.select("r.*", "content", X.checksum(F.col("content")).alias("checksum"), F.concat(F.col("r.source_id"), F.lit("--"), digits).alias("chunk_id"), "number", "source_location")


def postings(rows: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(language, token, field, id, tf): one row for each token of each field of a row. Counted before any shuffle."""
    parts = [F.struct(F.lit(name).alias("field"), X.terms(F.col(column)).alias("tokens")) for name, column in fields.items()]
    long = rows.select("language", F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("f")).select("language", "id", "f.field", F.explode("f.tokens").alias("token"))
    return long.groupBy("language", "token", "field", "id").agg(F.count("*").alias("tf"))


def vocabulary(post: DataFrame) -> DataFrame:
    return post.select("language", "token").distinct()


def relate(vocab: DataFrame, grams: DataFrame, asked: DataFrame) -> DataFrame:
    """(language, term, token) for all related pairs: equal, or both of five characters or more and one within the other.

    asked (language, term) are distinct terms; grams is segments.trigrams() of the vocabulary. All pairs meet in hash joins: a
    token that holds a term has the term's rarest trigram, and a term that holds a token has the token's key among its
    trigrams; the few that meet are compared in full.
    """
    asked = sent(asked)
    equal = vocab.join(asked.withColumnRenamed("term", "token"), ["language", "token"]).select("language", F.col("token").alias("term"), "token")
    own = sent(asked.where(F.length("term") >= 5).select("language", "term", F.explode(segments.grams_of(F.col("term"))).alias("gram")))
    counts = own.join(grams.select("language", "gram"), ["language", "gram"]).groupBy("language", "term", "gram").agg(F.count("*").alias("n"))
    rarest = sent(counts.groupBy("language", "term").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")))
    holds = rarest.join(grams.select("language", "gram", "token"), ["language", "gram"]).where(F.col("token").contains(F.col("term")))
    held = own.join(grams.where("is_key").select("language", "gram", "token"), ["language", "gram"]).where(F.col("term").contains(F.col("token")))
    within = holds.unionByName(held).where("token <> term").select("language", "term", "token")
    return equal.unionByName(within).distinct()


def with_locations(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records with locations: the spans of the imported document of the same source, null for records without one."""
    own = manifest.select("source_id", F.col("locations").alias("__l"))
    return records.join(own, "source_id", "left").withColumn("locations", F.col("__l")).drop("__l")


def _sound(records: DataFrame) -> DataFrame:
    """The active records; ValueError names the first faults."""
    from gleaner.operators import records as R

    bad = R.validated(records).where("reason IS NOT NULL").select("source_id", "reason").unionByName(R.repeated(records, "source_id").select("source_id", F.lit("repeated_id").alias("reason"))).limit(4).collect()
    if bad:
        raise ValueError("; ".join(f"{r.source_id}: {r.reason}" for r in bad))
    return R.active(records)


def build_index(records: DataFrame, folder: str, spans_col: str | None = None) -> segments.Index:
    """Validated records to a stored index: active ones are cut into chunks. ValueError names the first faults.

    In a folder that has an index already, only what differs from it is written. The revision has a digest of the
    records that it was made from.
    """
    from gleaner.operators import versions

    active = _sound(records)
    segments.update(active, folder, lambda own: chunks(own, spans_col), versions.content_digest(active))
    return segments.Index.read(records.sparkSession, folder)


def open_index(records: DataFrame, folder: str) -> tuple[segments.Index | None, str]:
    """(index or None, status): ready, if the index was made from exactly the active records; not_built or stale_or_invalid otherwise."""
    from gleaner.operators import records as R
    from gleaner.operators import versions

    spark = records.sparkSession
    mark = segments.mark_of(spark, folder)
    if mark is None:
        return None, "not_built"
    if mark != versions.content_digest(R.active(records)):
        return None, "stale_or_invalid"
    return segments.Index.read(spark, folder), "ready"
