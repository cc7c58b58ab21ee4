"""Versioned datasets: immutable folders of Parquet, a manifest with checksums, and a pointer with revisions.

Manifests are a few rows that the driver reads; the data never pass it. Each revision of the pointer is a file of its
own, which is renamed into place only if there is none of its number: a reader always sees a whole revision, and of two
writers that start from the same one the second fails. A change must name the revision or the digest it was made from.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.storage import cut

#: The present format: one more than there are steps in MIGRATIONS.
FORMAT = 2
_VERSION, _DATASET = re.compile(r"[0-9a-f]{32}"), re.compile(r"[A-Za-z][A-Za-z0-9_]*")


class Conflict(ValueError):
    """The dataset changed meanwhile, or a change breaks one of its rules."""


def _row_hash(columns: list[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")


def content_digest(df: DataFrame) -> dict:
    """Rows and an order-free digest, which executors add up: equal for equal multisets of rows."""
    got = df.agg(F.count("*").alias("rows"), F.sum(_row_hash(df.columns)).alias("sum")).first()
    return {"rows": got.rows, "digest": str(got["sum"] or 0)}


def file_digests(df: DataFrame) -> DataFrame:
    """(file, bytes, rows, digest) of the files of a table that was read from a folder; files without rows have none."""
    own = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), _row_hash(df.columns).alias("h"))
    return own.groupBy("file", "bytes").agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("digest"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, extra, equal): multiset differences both ways, from one aggregate by whole rows."""
    columns = sorted(a.columns)
    marked = a.select(*columns, F.lit(1).alias("__d")).unionByName(b.select(*columns, F.lit(-1).alias("__d")))
    net = marked.groupBy(*columns).agg(F.sum("__d").alias("d"))
    out = net.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("extra"))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def coverage_drop(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """One row (old_count, missing, fraction): the share of old keys that are gone."""
    ids = old.select(key).distinct()
    gone = ids.join(new.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    out = gone.agg(F.count("*").alias("old_count"), F.count_if(F.col("__in").isNull()).alias("missing"))
    return out.withColumn("fraction", F.when(F.col("old_count") > 0, F.col("missing") / F.col("old_count")).otherwise(0.0))


class Versions:
    """Versions of named datasets in a folder that Spark writes to.

    rules gives the faults of a version's datasets (a graph's violations, say); each load asks it, and any fault refuses.
    """

    def __init__(self, spark: SparkSession, root: str, max_drop: float = 0.30, rules: Callable[[dict[str, DataFrame]], list[str]] | None = None):
        self.spark, self.root, self.max_drop, self.rules = spark, root.rstrip("/"), max_drop, rules
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first().value)

    def _create(self, name: str, value: dict) -> None:
        """Written beside and renamed if the name is free; Conflict if it is taken."""
        beside = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(beside, self._path(f"{self.root}/{name}"), keep)
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            raise Conflict(f"{name} is there already") from e

    def _revisions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("revision-") and n.endswith(".json"))

    def status(self) -> dict:
        """The latest revision: version, revision and how it came about."""
        known = self._revisions()
        if not known:
            return {"version": None, "revision": 0, "history": []}
        return self._read(f"revision-{known[-1]}.json") | {"history": [self._read(f"revision-{n}.json") for n in known]}

    def listing(self) -> DataFrame:
        """(version, home_url, created, format, revision): all versions, newest first, with the revision that made each active last, if any."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        made = [(n[:-5], m["home_url"], m["created"], m["format"]) for n in names if n.endswith(".json") and not n.startswith(("revision-", ".")) for m in [self._read(n)]]
        versions = self.spark.createDataFrame(made, "version string, home_url string, created double, format int")
        pointed = self.spark.createDataFrame([(h["version"], h["revision"]) for h in self.status()["history"]], "version string, revision int")
        return with_pointer(versions, pointed)

    def stage(self, datasets: dict[str, DataFrame], home_url: str) -> str:
        """Writes a version that is not active yet; its id. The manifest has each dataset's rows and digest; beside the data lie those of each file."""
        if odd := [n for n in datasets if not _DATASET.fullmatch(n)]:
            raise ValueError(f"not a dataset's name: {', '.join(odd)}")
        version = uuid.uuid4().hex
        parts = {}
        for name, df in datasets.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
            file_digests(self.spark.read.parquet(f"{self.root}/{version}/{name}")).coalesce(1).write.parquet(f"{self.root}/{version}/_files/{name}")
            parts[name] = self._total(f"{self.root}/{version}/_files/{name}")
        steps = [[m.version, m.name, m.checksum] for m in MIGRATIONS]
        self._create(f"{version}.json", {"format": FORMAT, "home_url": home_url, "datasets": parts, "created": time.time(), "steps": steps})
        return version

    def _total(self, folder: str) -> dict:
        """content_digest() of a dataset, from those of its files."""
        got = self.spark.read.parquet(folder).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("digest").cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()
        return {"rows": got.rows, "digest": str(got["sum"])}

    def manifest(self, version: str) -> dict:
        """A version's manifest; Conflict if the id could lead out of the folder, or if there is none in a known format and of known steps."""
        if not isinstance(version, str) or not _VERSION.fullmatch(version):
            raise Conflict("not a version's id")
        found = self._read(f"{version}.json")
        if found is None or not 1 <= found.get("format", 0) <= FORMAT or not all(map(_DATASET.fullmatch, found["datasets"])):
            raise Conflict("no such version in a known format")
        known = [(m.version, m.name, m.checksum) for m in MIGRATIONS[: found["format"] - 1]]
        if faults := migration_faults([tuple(x) for x in found.get("steps", known)], MIGRATIONS):
            raise Conflict("; ".join(faults))
        return found

    def file_faults(self, version: str, name: str) -> DataFrame:
        """(file, fault) of a dataset's files: missing, unknown, size, or content. Versions of the first format have no list of files."""
        want = self.spark.read.parquet(f"{self.root}/{version}/_files/{name}")
        got = file_digests(self.spark.read.parquet(f"{self.root}/{version}/{name}"))
        met = want.toDF("file", "b", "r", "d").join(got, "file", "full")
        fault = F.when(F.col("bytes").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(F.col("b") != F.col("bytes"), "size").when((F.col("r") != F.col("rows")) | (F.col("d") != F.col("digest")), "content")
        return met.select("file", fault.alias("fault")).where("fault IS NOT NULL")

    def load(self, version: str) -> dict[str, DataFrame]:
        """A version's datasets in the present format; Conflict unless all files are as they were written and `rules` finds no fault.

        Versions of older formats go through the steps since. The first damaged files are named.
        """
        manifest = self.manifest(version)
        out = {}
        for name, want in manifest["datasets"].items():
            try:
                out[name] = self.spark.read.parquet(f"{self.root}/{version}/{name}")
                damaged = [f"{r.file}: {r.fault}" for r in self.file_faults(version, name).orderBy("file").limit(4).collect()] if manifest["format"] > 1 else []
                got = content_digest(out[name]) if manifest["format"] == 1 else self._total(f"{self.root}/{version}/_files/{name}")
            except Exception as e:
                raise Conflict(f"{name} can't be read") from e
            if damaged:
                raise Conflict(f"{name} is not as it was written: {', '.join(damaged)}")
            if got != want:
                raise Conflict(f"{name} is not as it was written")
        for step in MIGRATIONS[manifest["format"] - 1 :]:
            out = step.apply(out)
        if self.rules and (faults := self.rules(out)):
            raise Conflict(f"the version has faults: {', '.join(faults[:4])}")
        return out

    def migrate(self, version: str) -> str:
        """A version of an older format, staged anew in the present one, with the steps that made it; its id."""
        manifest = self.manifest(version)
        return version if manifest["format"] == FORMAT else self.stage(self.load(version), manifest["home_url"])

    def activate(self, version: str, revision: int, key: str = "source_id", records: str = "records", replace_site: bool = False, allow_drop: bool = False, operation: str = "activate", check: Callable[[dict[str, DataFrame]], list[str]] | None = None) -> dict:
        """Makes a version the active one, if the revision is current, it has rows, and coverage doesn't drop too far.

        check gives the faults of the datasets as they are on disk (a graph's violations, say); any of them refuses.
        """
        status = self.status()
        if status["revision"] != revision:
            raise Conflict("the active version changed")
        new = self.load(version)
        if self._read(f"{version}.json")["datasets"][records]["rows"] == 0:
            raise Conflict("the version has no records")
        if status["version"] and operation == "activate":
            old = self.load(status["version"])
            if self._read(f"{version}.json")["home_url"] != self._read(f"{status['version']}.json")["home_url"] and not replace_site:
                raise Conflict("the site changed")
            if coverage_drop(old[records], new[records], key).first().fraction > self.max_drop and not allow_drop:
                raise Conflict("coverage dropped")
        if check and (faults := check(new)):
            raise Conflict(f"the version has faults: {', '.join(faults[:4])}")
        self._create(f"revision-{revision + 1}.json", {"revision": revision + 1, "version": version, "operation": operation, "at": time.time()})
        return self.status()

    def restore(self, version: str, revision: int, check: Callable[[dict[str, DataFrame]], list[str]] | None = None) -> dict:
        """An earlier version again, whose datasets are checked as if it were new."""
        return self.activate(version, revision, operation="restore", check=check)

    def completed(self, version: str, automatic: bool = True, **kw) -> dict:
        """What becomes of a staged build: staged (not automatic), active, or review_required with the reason."""
        if not automatic:
            return {"state": "staged", "reason": "automatic activation is off"}
        try:
            return {"state": "active", "version": self.activate(version, self.status()["revision"], **kw)["version"]}
        except Conflict as e:
            return {"state": "review_required", "reason": str(e)}

    def change(self, name: str, digest: dict, edit: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], **kw) -> dict:
        """Replaces one dataset of the active version by edit(dataset), if the caller saw its present content.

        digest is content_digest() of what was edited. Loading holds the dataset on disk against the manifest, so a
        file that was changed by other hands is a Conflict, too; so are rows of check(candidate). The version before
        stays whole: it is the backup.
        """
        status = self.status()
        now = self.active()
        if self._read(f"{status['version']}.json")["datasets"][name] != digest:
            raise Conflict(f"{name} changed meanwhile")
        candidate = edit(now[name])
        faults = check(candidate).limit(4).collect()
        if faults:
            raise Conflict("; ".join(" ".join(str(v) for v in f if v is not None) for f in faults))
        version = self.stage(now | {name: candidate}, self._read(f"{status['version']}.json")["home_url"])
        return self.activate(version, status["revision"], operation="change", **kw)

    def backup(self, folder: str) -> dict:
        """Copies the active version's datasets to a new folder with a manifest of rows, digests, bytes and columns."""
        place = self._path(folder)
        if self._fs.exists(place):
            raise Conflict("the backup's folder exists")
        listed = []
        for name, df in self.active().items():
            df.write.parquet(f"{folder}/{name}")
            listed.append({"dataset": name, **content_digest(self.spark.read.parquet(f"{folder}/{name}")), "bytes": self._bytes(f"{folder}/{name}"), "columns": df.columns})
        manifest = {"format": FORMAT, "created": time.time(), "datasets": listed}
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
        return manifest

    def _bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def backup_faults(self, folder: str, expected: tuple[str, ...]) -> list[str]:
        """What is wrong with a backup: manifest, inventory, sizes, columns and contents; nothing if it is whole."""
        try:
            manifest = json.loads(self.spark.read.text(f"{folder}/manifest").first().value)
            listed = {d["dataset"]: d for d in manifest["datasets"]}
            if manifest["format"] != FORMAT:
                return ["format"]
        except Exception:
            return ["manifest"]
        if set(listed) != set(expected):
            return ["inventory"]
        out = []
        for name, want in listed.items():
            try:
                df = self.spark.read.parquet(f"{folder}/{name}")
                got = {**content_digest(df), "bytes": self._bytes(f"{folder}/{name}"), "columns": df.columns}
            except Exception:
                got = {}
            out += [f"{name}: {k}" for k in ("rows", "digest", "bytes", "columns") if got.get(k) != want[k]]
        return out

    def active(self) -> dict[str, DataFrame]:
        version = self.status()["version"]
        if version is None:
            raise Conflict("no version is active")
        return self.load(version)


def with_pointer(versions: DataFrame, pointed: DataFrame) -> DataFrame:
    """versions with the latest revision that points to each; null where none does; newest first."""
    last = pointed.groupBy("version").agg(F.max("revision").alias("revision"))
    return versions.join(last, "version", "left").orderBy(F.desc("created"), "version")


@dataclass(frozen=True)
class Migration:
    """One step of the datasets' format: what it does to all of them."""

    version: int
    name: str
    apply: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(f"{self.version}:{self.name}".encode()).hexdigest()


def migration_faults(history: list[tuple[int, str, str]], migrations: tuple[Migration, ...]) -> list[str]:
    """What keeps a history of applied steps (version, name, checksum) from being the beginning of the known ones."""
    if [m.version for m in migrations] != list(range(1, len(migrations) + 1)):
        return ["the known steps are not numbered from 1"]
    if [h[0] for h in history] != list(range(1, len(history) + 1)) or len(history) > len(migrations):
        return ["the history is of another registry"]
    return [f"step {m.version} differs" for h, m in zip(history, migrations) if h[1:] != (m.name, m.checksum)]


def latest_formats(history: DataFrame) -> DataFrame:
    """(dataset, format): the greatest version that each dataset's history (dataset, version) names."""
    return history.groupBy("dataset").agg(F.max("version").alias("format"))


def _plain_records(datasets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Records as format 2 has them: languages without a region, a status for each, checksums with their kind."""
    if "records" not in datasets:
        return datasets
    r = datasets["records"]
    made = {
        "language": lambda c: F.regexp_extract(F.lower(c), r"^([^-_]*)", 1),
        "source_status": lambda c: F.coalesce(c, F.lit("active")),
        "checksum": lambda c: F.when(c.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("sha256:"), c)).otherwise(c),
    }
    return datasets | {"records": r.withColumns({c: f(F.col(c)) for c, f in made.items() if c in r.columns})}


#: Steps from each format to the next.
MIGRATIONS: tuple[Migration, ...] = (Migration(1, "plain_records", _plain_records),)


def changed(registry: DataFrame, changes: DataFrame, key: str = "source_id") -> DataFrame:
    """registry with the rows of `changes` added or in place of those of the same key."""
    return registry.join(changes.select(key), key, "left_anti").unionByName(changes.select(*registry.columns))


def edited_registry(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate, faults (source_id, fault)) of changes (operation, and the registry's columns).

    add wants a new source_id, update, archive and activate a known one; update keeps the status, archive and activate
    change nothing else. One change of a source at a time; changes with a fault have no effect.
    """
    known = registry.select("source_id", F.col("source_status").alias("__status"))
    twice = changes.groupBy("source_id").agg(F.count("*").alias("__n"))
    c = changes.join(known, "source_id", "left").join(twice, "source_id")
    fault = (
        F.when(~F.col("operation").isin("add", "update", "archive", "activate"), "unknown_operation")
        .when(F.col("__n") > 1, "several_changes")
        .when((F.col("operation") == "add") & F.col("__status").isNotNull(), "source_exists")
        .when((F.col("operation") != "add") & F.col("__status").isNull(), "source_missing")
    )
    c = c.withColumn("__fault", fault)
    good = c.where("__fault IS NULL")
    fresh = good.where("operation IN ('add', 'update')").withColumn("source_status", F.when(F.col("operation") == "add", "active").otherwise(F.col("__status")))
    status = good.where("operation IN ('archive', 'activate')").select("source_id", F.when(F.col("operation") == "archive", "archived").otherwise("active").alias("__new"))
    kept = registry.join(status, "source_id", "left").withColumn("source_status", F.coalesce("__new", "source_status")).select(*registry.columns)
    return changed(kept, fresh.select(*registry.columns)), c.where("__fault IS NOT NULL").select("source_id", F.col("__fault").alias("fault"))


def registry_faults(registry: DataFrame, most: int = 200, contacts: DataFrame | None = None, relationships: DataFrame | None = None) -> DataFrame:
    """(fault, value): repeated ids, repeated URLs of a language, too many sources, none active, active contacts and graph rows that would lose their source."""
    ids = registry.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_id").alias("fault"), F.col("source_id").alias("value"))
    urls = registry.groupBy("canonical_url", "language").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_url"), F.concat_ws(" ", "canonical_url", "language"))
    total = registry.agg(F.count("*").alias("n"), F.count_if(F.col("source_status") == "active").alias("a"))
    out = ids.union(urls).union(total.where(F.col("n") > most).select(F.lit("too_many"), F.col("n").cast("string"))).union(total.where("a = 0").select(F.lit("none_active"), F.lit("")))
    active = registry.where("source_status = 'active'")
    if contacts is not None:
        from gleaner.operators.routing import contacts_without_source

        out = out.union(contacts_without_source(contacts, registry).select(F.lit("contact_without_source"), F.col("contact_id").cast("string")))
    if relationships is not None:
        lost = relationships.join(active.select("source_id"), "source_id", "left_anti")
        out = out.union(lost.select(F.lit("relationship_without_source"), F.col("row").cast("string")))
    return out


#: Digests that one digest of the next level covers.
LEAVES = 1024


def sequence_digests(rows: DataFrame, order: list[str], fan: int = LEAVES) -> DataFrame:
    """(level, node, n_rows, digest): a tree of digests over the rows in order, equal for equal sequences however they are dealt.

    A row's digest is SHA-256 of its canonical JSON, columns by name; rows of equal `order` come by it. Node k of level 1
    covers rows k * fan to (k + 1) * fan - 1, a node of level l + 1 `fan` nodes of level l; the digest covers theirs, in order.
    The last level is the root. A row's place is its place in its part plus the rows of the parts before, of which the
    driver has one number each; a group is `fan` digests. A table without rows has the root of no digests.
    """
    spark = rows.sparkSession
    own = rows.select(*order, F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("digest"))
    sorted_ = cut(own.orderBy(*order, "digest").select("digest", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = {r.p: r.n for r in sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each part
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if not total:
        return spark.createDataFrame([(1, 0, 0, hashlib.sha256(b"").hexdigest())], "level int, node long, n_rows long, digest string")
    offsets = spark.createDataFrame(list(before.items()), "p long, before long")
    level = sorted_.join(F.broadcast(offsets), part == F.col("p")).select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("node"), F.lit(1).cast("long").alias("n_rows"), "digest")
    out, depth, nodes = None, 0, total
    while depth == 0 or nodes > 1:
        depth, nodes = depth + 1, -(-nodes // fan)
        of_parent = level.groupBy(F.floor(F.col("node") / fan).alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("d"))
        level = cut(of_parent.select("node", "n_rows", F.sha2(F.array_join(F.transform("d", lambda x: x["digest"]), ""), 256).alias("digest")))
        mine = level.select(F.lit(depth).alias("level"), "node", "n_rows", "digest")
        out = mine if out is None else out.unionByName(mine)
    return out


def ordered_digest(rows: DataFrame, order: list[str]) -> str:
    """The root of sequence_digests(): equal for equal sequences of rows."""
    return sequence_digests(rows, order).orderBy(F.desc("level")).first().digest


def first_difference(a: DataFrame, b: DataFrame, fan: int = LEAVES) -> tuple[int, int] | None:
    """[low, high) of the first rows in which two sequences (trees of sequence_digests()) differ; None if they are equal.

    From the root down, one level's nodes under the node that differs are compared: `fan` digests at a time.
    """
    top = max(t.agg(F.max("level")).first()[0] for t in (a, b))
    low, high = 0, 1
    for level in range(top, 0, -1):
        here = lambda t, name: t.where((F.col("level") == level) & F.col("node").between(low, high - 1)).select("node", F.col("digest").alias(name))  # noqa: E731, B023
        met = here(a, "x").join(here(b, "y"), "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).agg(F.min("node")).first()[0]
        if met is None:
            if level == top and {r.digest for r in a.where(F.col("level") == top).collect()} == {r.digest for r in b.where(F.col("level") == top).collect()}:
                return None
            met = low  # the trees have different heights
        low, high = met * fan, (met + 1) * fan
    return low, high


def recovered(jobs: DataFrame, now: float) -> DataFrame:
    """jobs (state, lease_until, error) with those whose lease ran out while they were queued or crawling as interrupted."""
    lost = F.col("state").isin("queued", "crawling") & (F.col("lease_until") < now)
    return jobs.withColumns({"state": F.when(lost, "interrupted").otherwise(F.col("state")), "error": F.when(lost, "worker_interrupted").otherwise(F.col("error"))})


def finished(jobs: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """jobs (job_id, state, cancel_requested, lease_until, error) after outcomes (job_id, outcome, message): only running jobs under a lease change, and a job that was asked to stop is cancelled whatever came out."""
    o = outcomes.select("job_id", F.col("outcome").alias("__o"), F.col("message").alias("__e"))
    running = F.col("__o").isNotNull() & F.col("state").isin("queued", "crawling") & (F.col("lease_until") >= now)
    state = F.when(~F.coalesce(running, F.lit(False)), F.col("state")).when(F.col("cancel_requested"), "cancelled").otherwise(F.col("__o"))
    return jobs.join(o, "job_id", "left").withColumns({"state": state, "error": F.when(running, F.col("__e")).otherwise(F.col("error"))}).select(*jobs.columns)
