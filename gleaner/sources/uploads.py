"""Uploaded documents: their bytes by content, and a manifest that changes with them or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.versions import Conflict, Versions
from gleaner.sources.imports import MOST_DOCUMENTS, approved_documents

MANIFEST = "document_id string, path string, source_id string, byte_size long, checksum string, status string"


class Uploads(Versions):
    """Documents in a folder, in two phases: bytes and the new manifest are written beside what is there, then a revision names them.

    A revision is a small file that is renamed into place if its number is free. A crash before that leaves the old state
    whole, and what was written is no one's until `vacuum` removes it; of two writers the second gets a Conflict.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = MOST_DOCUMENTS):
        super().__init__(spark, root)
        self.most = most

    def _state(self) -> dict:
        known = self._revisions()
        return self._read(f"revision-{known[-1]}.json") if known else {"revision": 0, "bytes": [], "manifest": None}

    def manifest(self) -> DataFrame:
        """The documents (MANIFEST)."""
        at = self._state()["manifest"]
        return self.spark.read.parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], MANIFEST)

    def prepare(self, files: DataFrame) -> tuple[dict, DataFrame]:
        """The first phase for files (path, content binary, source_id): (the state to commit, refused (path, reason)); what holds is not touched."""
        state = self._state()
        listed, refused = approved_documents(self.manifest(), files, self.most)
        name = uuid.uuid4().hex
        listed.write.parquet(f"{self.root}/manifest-{name}")
        refused.write.parquet(f"{self.root}/refused-{name}")
        fresh = self.spark.read.parquet(f"{self.root}/manifest-{name}").join(self.manifest().select("checksum"), "checksum", "left_anti")
        content = files.withColumn("checksum", F.concat(F.lit("sha256:"), F.sha2("content", 256))).join(fresh.select("checksum", "path"), ["checksum", "path"], "left_semi")
        content.select("checksum", "content").dropDuplicates(["checksum"]).write.parquet(f"{self.root}/bytes-{name}")
        new = {"revision": state["revision"] + 1, "bytes": [*state["bytes"], f"bytes-{name}"], "manifest": f"manifest-{name}"}
        return new, self.spark.read.parquet(f"{self.root}/refused-{name}")

    def commit(self, state: dict) -> None:
        """The second phase: every listed document's bytes must be there, then the revision is the present one."""
        held = self.spark.read.parquet(*(f"{self.root}/{b}" for b in state["bytes"])).select("checksum")
        if not self.spark.read.parquet(f"{self.root}/{state['manifest']}").join(held, "checksum", "left_anti").isEmpty():
            raise Conflict("a document has no bytes")
        self._create(f"revision-{state['revision']}.json", state)

    def add(self, files: DataFrame) -> DataFrame:
        """Both phases; the refused files (path, reason)."""
        state, refused = self.prepare(files)
        self.commit(state)
        return refused

    def contents(self) -> DataFrame:
        """(document_id, path, content) of all documents, held against their checksums; Conflict if one differs."""
        rows = self.manifest().join(self.spark.read.parquet(*(f"{self.root}/{b}" for b in self._state()["bytes"])), "checksum")
        if not rows.where(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col("checksum")).isEmpty():
            raise Conflict("stored bytes differ from their checksum")
        return rows.select("document_id", "path", "content")

    def vacuum(self) -> list[str]:
        """Removes folders that the present state does not name; their names."""
        state = self._state()
        used = {*state["bytes"], state["manifest"]}
        gone = [n for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory() and (n := f.getPath().getName()) not in used]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return sorted(gone)
