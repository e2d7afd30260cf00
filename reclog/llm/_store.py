"""Shared-folder tables, global ranks and connected components for the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; texts can be long, so this stays well under Spark's default.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the memory of Arrow batches of texts, and send this package's functions to executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Unset, a local master gets a temporary
    folder, as in tests; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reclog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_of(name: str = "text"):
    """The text, with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text"):
    """Digest of the text: with the id, the key of a row, as ids may be null or repeated."""
    return F.unhex(F.sha2(F.encode(text_of(name), "utf-8"), 256))


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Add the 0-based rank in the order of keys over the whole table, without one task for all rows.

    Rows are range-partitioned and sorted, saved with their place in their partition, and each partition's
    offset comes from a table with one row for each partition. Rows equal in all keys are interchangeable.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    spots = sizes.agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("s"))  # one entry for each partition
    offsets = spots.selectExpr("explode(transform(s, (x, i) -> struct(x._part as _part, aggregate(slice(s, 1, i), 0L, (a, y) -> a + y._n) as _before)))").select("col.*")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_at", "_before")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes that have an edge.

    Each round takes the least label among neighbours, with partial aggregation, and then jumps to the label's
    own label, so a component of diameter d ends after about log d rounds. Rounds are written to the shared folder.
    """
    both = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct(), "edges")
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("u"), "root"), "u").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("to"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))
        new = saved(step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("root"), "old"), "labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
