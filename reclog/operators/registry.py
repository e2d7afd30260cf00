"""The registry of streams: names and dense ids as a bijection, from facts that may repeat but not contradict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["namespace", "stream"]


def conflicts(registry: DataFrame, facts: DataFrame) -> DataFrame:
    """(namespace, stream, stream_id, fault) of facts that contradict the registry or each other: NAME where a name has
    another id, ID where an id has another name."""
    every = registry.select(*KEYS, "stream_id").unionByName(facts.select(*KEYS, "stream_id")).distinct()
    names = every.groupBy(*KEYS).agg(F.count("*").alias("_ids"))
    ids = every.groupBy("stream_id").agg(F.count("*").alias("_names"))
    j = facts.select(*KEYS, "stream_id").distinct().join(names, KEYS).join(ids, "stream_id")
    fault = F.when(F.col("_ids") > 1, "NAME").when(F.col("_names") > 1, "ID")
    return j.select(*KEYS, "stream_id", fault.alias("fault")).where("fault is not null")


def applied(registry: DataFrame, facts: DataFrame) -> DataFrame:
    """The registry with the facts (namespace, stream, stream_id, created_entry_id) that it lacks and that contradict
    nothing; a fact that it holds changes nothing, so applying twice is applying once."""
    first = facts.groupBy(*KEYS, "stream_id").agg(F.min("created_entry_id").alias("created_entry_id"))
    bad = conflicts(registry, facts).select(*KEYS, "stream_id")
    new = first.join(bad, [*KEYS, "stream_id"], "left_anti").join(registry.select(*KEYS), KEYS, "left_anti")
    return registry.select(*KEYS, "stream_id", "created_entry_id").unionByName(new.select(*KEYS, "stream_id", "created_entry_id"))


def overlaid(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Base and delta as one view: what both hold comes from the delta."""
    cols = [*KEYS, "stream_id", "created_entry_id"]
    return base.select(*cols).join(delta.select(*KEYS), KEYS, "left_anti").unionByName(delta.select(*cols))


def assigned(registry: DataFrame, names: DataFrame) -> DataFrame:
    """(namespace, stream, stream_id, new) for names (namespace, stream, arrival): the id that a name has, or the next
    dense ids by first arrival. The window runs over new streams, one row each."""
    first = names.groupBy(*KEYS).agg(F.min("arrival").alias("arrival"))
    top = registry.agg(F.coalesce(F.max("stream_id"), F.lit(0)).alias("_top"))  # one row
    old = first.join(registry.select(*KEYS, "stream_id"), KEYS).select(*KEYS, "stream_id", F.lit(False).alias("new"))
    new = first.join(registry.select(*KEYS), KEYS, "left_anti").withColumn("_r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("arrival", *KEYS)))
    return old.unionByName(new.join(F.broadcast(top)).select(*KEYS, (F.col("_top") + F.col("_r")).cast("long").alias("stream_id"), F.lit(True).alias("new")))


def rebuilt_faults(facts: DataFrame) -> DataFrame:
    """(sequence, fault) of registry records that a rebuild must fail on: the record at sequence k assigns id k+1, and
    none is missing. Facts have sequence and stream_id."""
    before = facts.select((F.col("sequence") + 1).alias("sequence"), F.lit(True).alias("_before"))
    j = facts.join(before, "sequence", "left")
    fault = F.when((F.col("sequence") > 0) & F.col("_before").isNull(), "GAP").when(F.col("stream_id") != F.col("sequence") + 1, "ID")
    return j.select("sequence", fault.alias("fault")).where("fault is not null")


def layered_tails(catalog: DataFrame, active: DataFrame) -> DataFrame:
    """(stream, next_sequence, source): the active tail where there is one, else the catalogue's."""
    j = catalog.select("stream", F.col("next_sequence").alias("_c")).join(active.select("stream", F.col("next_sequence").alias("_a")), "stream", "full")
    return j.select("stream", F.coalesce("_a", "_c").alias("next_sequence"), F.when(F.col("_a").isNotNull(), "active").otherwise("catalog").alias("source"))
