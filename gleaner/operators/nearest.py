"""Exact search among vectors by angle, for many questions, that leaves out what the triangle inequality rules out.

Vectors are grouped around centres. The angle between a question and a vector is at least the difference of their angles
to a centre; so a whole group is left out if its centre is further from the question than its radius and the wanted
angle, and of the other groups only a ring is compared. Nothing is lost: the bounds are proven, not guessed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.storage import cut

#: The most centres, which tasks hold, and the vectors that centres are fitted on; every vector is in the index.
CENTRES, FITTED, ROUNDS = 4096, 20_000, 4
#: Rounding of angles.
SLACK = 1e-6
#: Vectors of a cell, which a task holds at once; questions and vectors that are multiplied at once; groups that give a question its first bound.
CELL, AT_ONCE, FIRST = 8192, 256, 8


@dataclass(frozen=True)
class Clusters:
    """centres: one row for each unit centre; members (cluster, angle to the centre, id, language, vector); sizes (cluster, n, radius)."""

    centres: np.ndarray
    members: DataFrame
    sizes: DataFrame


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def fitted_centres(vectors: DataFrame, id_col: str, centres: int | None = None) -> np.ndarray:
    """Unit centres by spherical k-means on FITTED vectors at most, those of least id hash; the square root of all vectors as many, CENTRES at most."""
    n = vectors.count()
    k = centres or max(1, min(CENTRES, isqrt(n)))
    sample = vectors.orderBy(F.xxhash64(id_col), id_col).limit(min(FITTED, max(n, 1))).select("vector").collect()  # FITTED vectors at most
    if not sample:
        return np.empty((0, 0))
    points = _unit(np.array([r.vector for r in sample], np.float64))
    own = points[:k].copy()
    for _ in range(ROUNDS):
        nearest = (points @ own.T).argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(size > 0, sums / np.where(size > 0, size, 1), own)
    return own


def clustered(vectors: DataFrame, id_col: str = "chunk_id", centres: int | None = None) -> Clusters:
    """The index of vectors (id, language, vector). Invalid vectors, and those of another length than most centres, are left out."""
    good = vectors.where(V.valid(F.col("vector"))).select(F.col(id_col).alias("id"), "language", F.col("vector").cast("array<double>").alias("vector"))
    lengths = good.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    width = lengths.d if lengths else 0
    good = good.where(F.size("vector") == width)
    made = fitted_centres(good, "id", centres)
    sent = good.sparkSession.sparkContext.broadcast(made)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = _unit(_matrix(batch.column(2), width)) @ sent.value.T
                best = like.argmax(axis=1)
                angle = np.arccos(np.clip(like[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(angle), *batch.columns], ["cluster", "angle", *batch.schema.names])

    kind = good.schema["id"].dataType.simpleString()
    members = good.mapInArrow(assigned, f"cluster int, angle double, id {kind}, language string, vector array<double>")
    return Clusters(made, members, members.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius")))


def _to_centres(clusters: Clusters, questions: DataFrame) -> DataFrame:
    """(question columns, cluster, to_centre): each question with each centre, of which there are CENTRES at most."""
    width = clusters.centres.shape[1]
    sent = questions.sparkSession.sparkContext.broadcast(clusters.centres)
    at = questions.columns.index("vector")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = batch.slice(low, 64)
                angle = np.arccos(np.clip(_unit(_matrix(rows.column(at), width)) @ sent.value.T, -1, 1))
                again = pa.array(np.repeat(np.arange(rows.num_rows), angle.shape[1]))
                cluster = pa.array(np.tile(np.arange(angle.shape[1], dtype=np.int32), rows.num_rows))
                yield pa.RecordBatch.from_arrays([*(c.take(again) for c in rows.columns), cluster, pa.array(angle.ravel())], [*rows.schema.names, "cluster", "to_centre"])

    usable = questions.where(V.valid(F.col("vector")) & (F.size("vector") == width))
    kinds = ", ".join(f"{c} {questions.schema[c].dataType.simpleString()}" for c in questions.columns)
    return usable.mapInArrow(measured, f"{kinds}, cluster int, to_centre double")


def compared_pairs(clusters: Clusters, questions: DataFrame, least: Column) -> DataFrame:
    """The pairs of questions (question_id, language, vector) and members that may have a cosine of `least` (a column of questions) or more."""
    wanted = questions.withColumn("__wanted", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least))) + SLACK)
    near = _to_centres(clusters, wanted).join(clusters.sizes.select("cluster", "radius"), "cluster").where(F.col("to_centre") - F.col("radius") <= F.col("__wanted"))
    asked = near.select("question_id", "language", F.col("vector").alias("q"), "cluster", "to_centre", "__wanted")
    ring = F.abs(F.col("to_centre") - F.col("angle")) <= F.col("__wanted")
    return asked.join(clusters.members, ["cluster", "language"]).where(ring)


def within(clusters: Clusters, questions: DataFrame, least: Column | float) -> DataFrame:
    """(question_id, chunk_id, similarity) of all members of a question's language with a cosine of `least` or more. A null language of a question has none."""
    limit = F.lit(float(least)) if isinstance(least, (int, float)) else least
    pairs = compared_pairs(clusters, questions.withColumn("__least", limit), F.col("__least"))
    found = pairs.select("question_id", F.col("id").alias("chunk_id"), V.cosine(F.col("vector"), F.col("q")).alias("similarity"), F.cos(F.col("__wanted") - SLACK).alias("l"))
    return found.where(F.col("similarity") >= F.col("l") - 1e-9).drop("l")


@dataclass(frozen=True)
class _Cells:
    """Groups dealt into cells of about CELL vectors: small groups share one, a large group has several. Arrays by cluster."""

    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, clusters: Clusters) -> _Cells:
        radius, n = np.full(len(clusters.centres), -np.inf), np.zeros(len(clusters.centres), np.int64)
        for r in clusters.sizes.collect():  # a row for each centre, CENTRES at most
            radius[r.cluster], n[r.cluster] = r.radius, r.n
        parts = np.maximum(1, -(-n // CELL))
        shared = np.where(parts == 1, n, 0)
        return cls(radius, np.where(parts == 1, np.cumsum(shared) // CELL, np.cumsum(shared)[-1:].sum() // CELL + 1 + np.cumsum(parts) - parts), parts)


def _ranked(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The place of each row, from 0, within its group, where rows are taken in `order` and groups stand together."""
    g = group[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return place


class _Members:
    """The vectors of a cell in one language; of equal vectors only the k of least id, as no other is ever among a question's k."""

    def __init__(self, cluster: np.ndarray, ids: pa.Array, vectors: np.ndarray, k: int):
        by_id = np.empty(len(ids), np.int64)
        by_id[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        same = np.unique(np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
        stay = np.flatnonzero(_ranked(np.lexsort((by_id, same)), same) < k)
        stay = stay[np.argsort(cluster[stay], kind="stable")]
        self.ids, self.by_id, self.cluster, self.vectors = ids.take(pa.array(stay)), by_id[stay], cluster[stay], vectors[stay]
        self.norms = _norms(self.vectors)
        self.units = _unit(self.vectors)

    def best(self, asked: np.ndarray, least: np.ndarray, reached: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question's row, member's row, cosine): the k best of each question among the groups that it reaches (a bit for each group), of `least` or more.

        Matrix products tell who may be among them; the cosines are then summed in order, as V.cosine() does.
        """
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        units = _unit(asked)
        bounds = np.append(np.flatnonzero(np.concatenate(([True], self.cluster[1:] != self.cluster[:-1]))), len(self.cluster))
        for low, high in zip(bounds[:-1], bounds[1:]):
            here = np.flatnonzero(reached[:, self.cluster[low]])
            for at in range(0, len(here), AT_ONCE):
                own = here[at : at + AT_ONCE]
                like = units[own] @ self.units[low:high].T
                floor = least[own].copy()
                unbounded = np.flatnonzero(floor <= -1) if high - low > k else []
                if len(unbounded):
                    floor[unbounded] = np.partition(like[unbounded], -k, axis=1)[:, -k]
                x, y = np.nonzero(like >= floor[:, None] - 1e-9)
                rows.append(own[x])
                cols.append(y + low)
        row, col = np.concatenate(rows), np.concatenate(cols)
        cosine = np.empty(len(row))
        norms = _norms(asked)
        for at in range(0, len(row), 1 << 14):
            x, y = row[at : at + (1 << 14)], col[at : at + (1 << 14)]
            cosine[at : at + (1 << 14)] = np.cumsum(self.vectors[y] * asked[x], axis=1)[:, -1] / (self.norms[y] * norms[x])
        stay = _ranked(np.lexsort((self.by_id[col], -cosine, row)), row) < k if len(row) else np.empty(0, bool)
        return row[stay], col[stay], cosine[stay]


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1])


def _best_of_cells(clusters: Clusters, cells: _Cells, questions: DataFrame, k: int, first: bool) -> DataFrame:
    """(question_id, id, similarity): what of each cell may be among the k best of questions (question_id, language, vector, __least).

    With `first` only the FIRST nearest groups of a question are looked at, else all that its bound allows. A question
    goes once to each cell that it reaches; a task holds one cell and streams the questions.
    """
    spark = questions.sparkSession
    width = clusters.centres.shape[1]
    sent = spark.sparkContext.broadcast((clusters.centres, cells))
    kind, q_kind = clusters.members.schema["id"].dataType.simpleString(), questions.schema["question_id"].dataType.simpleString()

    def reached(asked: np.ndarray, least: np.ndarray) -> np.ndarray:
        centres, own = sent.value
        angle = np.arccos(np.clip(_unit(asked) @ centres.T, -1, 1))
        if first:
            at = min(FIRST, angle.shape[1]) - 1
            return angle <= np.partition(angle, at, axis=1)[:, at : at + 1] + SLACK
        return angle - own.radius <= np.arccos(np.clip(least, -1, 1))[:, None] + SLACK

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value[1]
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            part = np.arange(len(cluster)) % own.parts[cluster] if len(cluster) else cluster
            yield pa.RecordBatch.from_arrays([pa.array((own.first[cluster] + part).astype(np.int64)), *batch.columns], ["cell", *batch.schema.names])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value[1]
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(low, AT_ONCE)
                x, cluster = np.nonzero(reached(_matrix(rows.column(2), width), rows.column(3).to_numpy()))
                each = own.parts[cluster]
                part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                goes = np.unique(np.stack((np.repeat(x, each), np.repeat(own.first[cluster], each) + part), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(goes[:, 1].astype(np.int64)), *(c.take(pa.array(goes[:, 0])) for c in rows.columns)], ["cell", *rows.schema.names])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, made = None, [], None
        for batch in batches:
            number, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), [True]))) if len(number) else []
            for low, high in zip(edges[:-1], edges[1:]):
                rows = batch.slice(low, high - low)
                if number[low] != cell:
                    cell, held, made = number[low], [], None
                if not asks[low]:
                    held.append(rows)
                    continue
                if made is None:
                    whole = pa.Table.from_batches(held).combine_chunks() if held else None
                    made = {}
                    for language in whole.column("language").unique().to_pylist() if held else ():
                        part = whole.filter(pa.compute.equal(whole.column("language"), pa.scalar(language))).combine_chunks()
                        if part.num_rows:
                            made[language] = _Members(part.column("cluster").to_numpy(), part.column("id").combine_chunks(), _matrix(part.column("vector").combine_chunks(), width), k)
                    held = []
                languages = np.array(rows.column(5).to_pylist(), object)
                for language, members in made.items():
                    own = rows.take(pa.array(np.flatnonzero(languages == language)))
                    if own.num_rows:
                        asked, least = _matrix(own.column(6), width), own.column(7).to_numpy()
                        x, y, cosine = members.best(asked, least, reached(asked, least), k)
                        yield pa.RecordBatch.from_arrays([own.column(4).take(pa.array(x)), members.ids.take(pa.array(y)), pa.array(cosine)], ["question_id", "id", "similarity"])

    usable = questions.where(V.valid(F.col("vector")) & (F.size("vector") == width) & F.col("language").isNotNull())
    vectors = clusters.members.where(F.col("language").isNotNull()).select("cluster", "id", "language", "vector")
    vectors = vectors.mapInArrow(placed, f"cell long, cluster int, id {kind}, language string, vector array<double>")
    asked = usable.select("question_id", "language", F.col("vector").cast("array<double>").alias("vector"), F.col("__least").cast("double").alias("__least"))
    asked = asked.mapInArrow(routed, f"cell long, question_id {q_kind}, language string, vector array<double>, __least double")
    none = lambda k: F.lit(None).cast(k)
    left = vectors.select("cell", F.lit(False).alias("asks"), "cluster", "id", none(q_kind).alias("question_id"), "language", "vector", none("double").alias("__least"))
    right = asked.select("cell", F.lit(True).alias("asks"), none("int").alias("cluster"), none(kind).alias("id"), "question_id", "language", "vector", "__least")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.union(right).repartition(n, "cell").sortWithinPartitions("cell", "asks")
    return dealt.mapInArrow(compared, f"question_id {q_kind}, id {kind}, similarity double")


def first_bounds(clusters: Clusters, questions: DataFrame, k: int, cells: _Cells | None = None) -> DataFrame:
    """questions with __least: the k-th best cosine in the FIRST nearest groups, -1 if they hold fewer of the language."""
    if not len(clusters.centres):
        return questions.withColumn("__least", F.lit(-1.0))
    some = _best_of_cells(clusters, cells or _Cells.of(clusters), questions.withColumn("__least", F.lit(-1.0)), k, True)
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity")))).where(F.col("r") <= k)
    kth = ranked.groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("__least"))
    return questions.join(kth, "question_id", "left").withColumn("__least", F.coalesce("__least", F.lit(-1.0)))


def top_k(clusters: Clusters, questions: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, similarity, rank): each question's k nearest members of its language, ties by id; the rows of a full scan.

    Vectors are compared by matrix products, cell by cell. Where vectors have no structure, every question still meets
    every vector, but a question is sent once to a cell of CELL vectors, and k rows of a cell at most come back.
    """
    if not len(clusters.centres):
        none = clusters.members.select(F.col("id").alias("chunk_id")).where(F.lit(False))
        return none.select(F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"), "chunk_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    cells = _Cells.of(clusters)
    bounded = cut(first_bounds(clusters, questions, k, cells))
    w = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "id")
    found = _best_of_cells(clusters, cells, bounded, k, False).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("question_id", F.col("id").alias("chunk_id"), "similarity", "rank")
