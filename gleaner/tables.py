"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a new temporary one, which only
    does for a driver that runs all tasks itself."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark).rstrip('/')}/gleaner/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tables(self, **frames: DataFrame) -> list[DataFrame]:
        """Tables that don't need each other, written at the same time: small stages leave cores free for one another."""
        with ThreadPoolExecutor(len(frames)) as pool:
            jobs = [pool.submit(inheritable_thread_target(self.spark)(self.table), df, name) for name, df in frames.items()]
            return [j.result() for j in jobs]

    def discard(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch that no later step reads."""
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            delete_folder(self.spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of an undirected graph ``a, b``; the component is its smallest node.

    Each round takes the smallest label among neighbours and then the label of that label, so the number of rounds grows
    with the logarithm of the longest path. Labels are written out after each round. Isolated nodes don't appear.
    """
    both = scratch.table(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges"
    )
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = scratch.table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        step = scratch.table(step, "step")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = scratch.table(
            step.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("root", "component")).alias("component")),
            "labels",
        )
        scratch.discard(step, labels)
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
