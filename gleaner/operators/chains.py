"""Hash chains that grow by batches: the heads of all chains are the state, and a batch is appended once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import logs
from gleaner.operators.versions import Conflict, Versions


class ChainLog(Versions):
    """Chains of events in a folder: entries of each batch, and the head (place, hash) of each key after it.

    A revision names the batches so far and the heads; it is renamed into place, so a batch counts as a whole or not at all.
    An append reads the heads of the batch's keys and the batch, and none of the entries before.
    """

    def __init__(self, spark: SparkSession, root: str, fields: list[str], keys: list[str], order_col: str = "sequence"):
        super().__init__(spark, root)
        self.fields, self.keys, self.order_col = fields, keys, order_col

    def _state(self) -> dict:
        known = self._revisions()
        return self._read(f"revision-{known[-1]}.json") if known else {"revision": 0, "batch": None, "entries": [], "heads": None}

    def append(self, events: DataFrame, batch: int) -> bool:
        """Chains a batch to what is there; False, and nothing changes, if that batch or a later one is there already.

        Conflict if an event's place is not after its key's head, or is taken twice: a chain only grows. Two writers of one
        batch: the second gets a Conflict, and its files are no one's.
        """
        state = self._state()
        if state["batch"] is not None and batch <= state["batch"]:
            return False
        heads = self.spark.read.parquet(f"{self.root}/{state['heads']}") if state["heads"] else None
        name = uuid.uuid4().hex
        logs.chained(events, self.fields, self.keys, self.order_col, heads=heads).write.parquet(f"{self.root}/entries-{name}")
        made = self.spark.read.parquet(f"{self.root}/entries-{name}")
        place = F.col(self.order_col)
        twice = made.groupBy(*self.keys, self.order_col).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("x"))
        faults = twice if heads is None else twice.union(made.join(heads.withColumnRenamed(self.order_col, "__place"), self.keys).where(place <= F.col("__place")).select(F.lit(1)))
        if not faults.isEmpty():
            self._fs.delete(self._path(f"{self.root}/entries-{name}"), True)
            raise Conflict("an event is not after the head of its chain")
        last = made.groupBy(*self.keys).agg(F.max(F.struct(self.order_col, "event_hash")).alias("h")).select(*self.keys, f"h.{self.order_col}", "h.event_hash")
        if heads is not None:
            last = last.unionByName(heads.join(last.select(*self.keys), self.keys, "left_anti"))
        last.write.parquet(f"{self.root}/heads-{name}")
        self._create(f"revision-{state['revision'] + 1}.json", {"revision": state["revision"] + 1, "batch": batch, "entries": [*state["entries"], f"entries-{name}"], "heads": f"heads-{name}"})
        return True

    def entries(self) -> DataFrame:
        """All events with previous_hash and event_hash."""
        return self.spark.read.parquet(*(f"{self.root}/{n}" for n in self._state()["entries"]))

    def heads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._state()['heads']}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: a batch that the stream gives again is not appended again."""
        return lambda events, batch: (self.append(events, batch), None)[1]
