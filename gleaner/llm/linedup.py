"""Line dedup by overlapping windows of three lines, of DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

LINES = 3
#: The covered lines are sent to the texts where they have fewer bytes than this; else texts and lines are shuffled.
BROADCAST_BYTES = 64 << 20


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """All columns of the input, with `text_col` deduped and n_lines, n_removed (long) added.

    Every `lines` consecutive lines of a text are hashed to 128 bits. Of a window that occurs more than once, in
    one text or several, the first occurrence by (doc_id, place) stays, and the lines that later ones cover go;
    overlapping windows merge. Lines end at \\n and are compared as they are; windows of blank lines only are
    passed over. A null text stays null with 0 lines; texts of fewer lines are not changed; a text whose lines all
    go becomes empty. Null ids come last. Rows equal in id and text are one document: they get the same result and
    don't count as repeats of each other. Columns named n_lines or n_removed are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key = [F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")]
    parted = docs.where(F.col(text_col).isNotNull()).select(*key, F.split(text_col, "\n").alias("l"))
    parts = [lambda l, i, j=j: F.get(l, i + j) for j in range(lines)]
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("l") - lines),
        lambda i: F.struct(
            i.cast("int").alias("pos"),
            F.xxhash64(*(p(F.col("l"), i) for p in parts)).alias("h1"),
            F.xxhash64(F.lit(1), *(p(F.col("l"), i) for p in reversed(parts))).alias("h2"),
            F.concat(*(F.trim(p(F.col("l"), i)) for p in parts)).alias("all"),
        ),
    )
    windows = parted.where(F.size("l") >= lines).select("no_id", "id", "mark", F.explode(hashed).alias("w")).where(F.col("w.all") != "").select("no_id", "id", "mark", "w.pos", "w.h1", "w.h2")
    place = F.struct("no_id", "id", "mark", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h1", "h2", "first")
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    covered = later.groupBy("no_id", "id", "mark").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", F.col("pos") + (lines - 1))))).alias("__gone"))
    covered = covered.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__gone")
    covered = cut(covered)
    size = covered.agg(F.sum(24 + 4 * F.size("__gone"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        covered = F.broadcast(covered)
    joined = docs.join(covered, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark")), "left")
    all_lines = F.split(text_col, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(all_lines))
    return joined.select(*((text if c == text_col else F.col(c)).alias(c) for c in kept), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
