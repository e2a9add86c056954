"""Small helpers the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hushscan.operators.cluster import delete, scratch_path

#: a word: anything between ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables in the shared folder that one operator needs more than once.

    Every node can read them, so a lost executor costs no recompute, and
    ``drop`` removes a table as soon as its last reader is done.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = scratch_path(spark, "llm")
        self.count = 0

    def write(self, df: DataFrame, settle: bool = False) -> DataFrame:
        """``settle`` also frees the shuffle files behind the table.

        Spark removes them only once the driver has collected the garbage of
        the finished job, which may be long after they are of any use.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        if settle:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, table: DataFrame) -> None:
        delete(self.spark, table._scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(step: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    """Make a ``mapInArrow`` function of one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays(
                    [as_arrow(columns[f.name], f.type) for f in schema], schema=schema
                )

    return run


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


class Memo(dict):
    """A bounded cache in front of ``make``.

    When it is full its entries become the old generation, from which those
    still in use come back.
    """

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long).

    Returns (node, component) for every node with an edge to another node; the
    component is its smallest node.  Each round hooks every node below the
    smallest label around it and then jumps to that label's own label, so
    chains shorten geometrically.  Labels are aggregated before they are
    shuffled and only rounds, never nodes, are known to the driver.
    """
    both = edges.where("a <> b").selectExpr("explode(array(struct(a, b), struct(b as a, a as b))) as e")
    both = scratch.write(both.select("e.a", "e.b").distinct())
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).selectExpr(
        "node", "least(node, m) as component"
    ))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        hooked = near.join(labels, "node").selectExpr("node", "component as old", "least(component, m) as hook")
        hooked = scratch.write(hooked)
        jump = hooked.selectExpr("node as hook", "hook as up")
        after = scratch.write(
            hooked.join(jump, "hook").selectExpr("node", "old", "least(hook, up) as component")
        )
        scratch.drop(hooked)
        moved = after.where("old <> component").limit(1).count()
        scratch.drop(labels)
        labels = after.select("node", "component")
        labels._scratch_path = after._scratch_path
        if not moved:
            scratch.drop(both)
            return labels
