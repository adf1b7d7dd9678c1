"""A keyed table in buckets, with a manifest a version: a merge rewrites the buckets that its changes touch and no others."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import delete_folder

Rule = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """Rows by hash of their key in ``buckets`` folders; ``manifest/<version>.json`` names the folders that are current, the last
    batch of each stream that is in them, and a mark for incremental pulls. One writer at a time; readers see one version.

    A merge writes new folders for the touched buckets and then the manifest, which is the commit: a run that is lost before it
    leaves the table as it was, and a batch that is repeated after it changes nothing. The newest ``keep`` versions stay
    readable, what only older ones name is deleted. Choose ``buckets`` so that one fits into a task.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), schema, list(keys), buckets, keep

    # ---------------------------------------------------------------- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("manifest").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, at = self._files(), self._path(folder)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> dict:
        stream = self._files().open(self._path(f"manifest/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        version = max(self._versions(), default=0) if version is None else version
        return self._load(version) if version else {"version": 0, "batches": {}, "mark": None, "folders": {}}

    def version(self) -> int:
        return self.manifest()["version"]

    def mark(self):
        """What ``merge`` was last given as ``mark``; None at first."""
        return self.manifest()["mark"]

    def _commit(self, manifest: dict) -> None:
        files, name = self._files(), f"manifest/{manifest['version']}.json"
        begun = self._path(f"manifest/{uuid.uuid4().hex}.begun")
        out = files.create(begun, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(self._path(name)) or not files.rename(begun, self._path(name)):
            files.delete(begun, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by somebody else")
        self._forget(manifest["version"] - self.keep)

    def _forget(self, upto: int) -> None:
        """Delete versions up to this one, and the folders that no later one names."""
        old = [v for v in self._versions() if v <= upto]
        later = {f for v in self._versions() if v > upto for f in self._load(v)["folders"].values()}
        for v in old:
            for folder in set(self._load(v)["folders"].values()) - later:
                delete_folder(self.spark, f"{self.path}/{folder}")
            self._files().delete(self._path(f"manifest/{v}.json"), False)

    # ---------------------------------------------------------------- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(list(self.manifest(version)["folders"].values()))

    def _write(self, rows: DataFrame, count: int) -> dict[str, str]:
        """Rows into a new folder with one below it for each bucket that has any."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket()).repartition(count, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {n[len("bucket=") :]: f"{name}/{n}" for n in self._names(name) if n.startswith("bucket=")}

    def merge(self, changes: DataFrame, rule: Rule, batch: int | None = None, stream: str = "", mark=None) -> bool:
        """Put ``rule(old, changes)`` in place of the buckets that hold a key of the changes. With ``batch``, a batch of this
        stream that is in the table already changes nothing; returns whether anything was done. A null key has a bucket, too."""
        now = self.manifest()
        if batch is not None and now["batches"].get(stream, -1) >= batch:
            return False
        touched = {str(r[0]) for r in changes.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets`` rows
        folders = dict(now["folders"])
        if touched:
            old = self._rows([folders[b] for b in sorted(touched) if b in folders])
            written = self._write(rule(old, changes), len(touched))
            folders = {b: f for b, f in folders.items() if b not in touched} | written
        batches = now["batches"] | ({stream: batch} if batch is not None else {})
        self._commit({"version": now["version"] + 1, "batches": batches, "mark": now["mark"] if mark is None else mark, "folders": folders})
        return True

    def replace(self, rows: DataFrame) -> int:
        """All rows anew, in one step for readers: a snapshot."""
        now = self.manifest()
        self._commit(now | {"version": now["version"] + 1, "folders": self._write(rows, self.buckets)})
        return now["version"] + 1

    def prune(self, keep: Column) -> int:
        """Drop the rows for which ``keep`` isn't true; only buckets that hold such rows are rewritten. Returns how many those
        were."""
        now = self.manifest()
        stale = ~F.coalesce(keep, F.lit(False))
        touched = {str(r[0]) for r in self.read().where(stale).select(self.bucket().alias("b")).distinct().collect()}
        if touched:
            old = self._rows([now["folders"][b] for b in sorted(touched)])
            folders = {b: f for b, f in now["folders"].items() if b not in touched} | self._write(old.where(~stale), len(touched))
            self._commit(now | {"version": now["version"] + 1, "folders": folders})
        return len(touched)


def pull(table: BucketTable, fetch: Callable[[int], DataFrame], rule: Rule, at: str = "at") -> int:
    """SRC-26: rows that a source has had since the last pull, merged into the table; returns their number.

    ``fetch`` gets the time of the newest row that was pulled before, 0 at first, and returns what is as new or newer, so that
    rows of that same time aren't lost; the rule makes those that come again change nothing. The mark moves in the commit that
    holds the rows: a run that is lost in between pulls them again.
    """
    fresh = fetch(table.mark() or 0)
    found = fresh.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("newest")).first()
    if found["n"]:
        table.merge(fresh, rule, mark=found["newest"])
    return found["n"]
