"""A site's pages to everything that is made of them, one dataset for each stage of a build."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import graph, index
from gleaner.operators.duplicates import similar_pages
from gleaner.sources import pages as P
from gleaner.storage import remove

STAGES = ("records", "skipped", "similar", "chunks", "entities", "relationships", "aliases", "evidence", "report")


def build_site(pages: DataFrame, folder: str, home: str | None = None, languages: tuple[str, ...] = ("en", "sv"), caps: dict[str, int | None] = graph.CAPS) -> dict[str, DataFrame]:
    """Every dataset of STAGES under `folder`, each written before the next is made from it, and read back. Pages are extracted once, to a dataset that goes when it is parted."""
    spark = pages.sparkSession
    made: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        made[name] = spark.read.parquet(f"{folder}/{name}")
        return made[name]

    P.extract(pages, home, languages).write.parquet(f"{folder}/extracted")
    records, skipped = P.parted(spark.read.parquet(f"{folder}/extracted"))
    records = keep("records", records)
    keep("skipped", skipped)
    remove(spark, f"{folder}/extracted")
    keep("similar", similar_pages(records))
    keep("chunks", index.chunks(records, "sections"))
    for name, df in graph.build_graph(records, caps).items():
        keep(name, df)
    return made


def stage_counts(made: dict[str, DataFrame]) -> DataFrame:
    """(stage, n_rows) of each dataset."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows") for name, df in made.items()))


def build_report(made: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each stage has, how many headings gave no entity, and whether a cap cut the graph."""
    counts = stage_counts({name: made[name] for name in STAGES[:-1]})
    row = counts.agg(*(F.max(F.when(F.col("stage") == name, F.col("n_rows"))).alias(name) for name in STAGES[:-1]))
    return row.crossJoin(made["report"])  # one row each
