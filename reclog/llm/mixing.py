"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words by weight, held to a multiple of its own words. A source first takes whole
copies of all its documents; the rest of its target is a sample without repeats: document i has inclusion
probability p(i), a uniform number u(i) from a hash, and rank q(i) = odds(u) / odds(p). Documents are taken in the
order of q until the words of the rest are reached, so the sample has a fixed size in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import saved, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Inclusion odds fall with the size class to this power: very long texts enter less often, and none makes up much of a sample.
TEMPER = 0.25
#: Cells of the order, for sums by cell before any sort; only the cell at the cut is sorted.
CELLS = 4096


def filled(df: DataFrame, by: list[str], amount: str, cap: str, weight: str, out: str) -> DataFrame:
    """Add out = least(cap, level * weight), with the level of each group by such that out sums to amount.

    Rows are few: one for each source, or for each source and size class.
    """
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    o = w.orderBy((F.col(cap) / F.col(weight)).asc(), F.col(weight), F.col(cap)).rowsBetween(W.unboundedPreceding, -1)
    total, before, weights = F.sum(weight).over(w), F.coalesce(F.sum(cap).over(o), F.lit(0.0)), F.coalesce(F.sum(weight).over(o), F.lit(0.0))
    df = df.withColumn("_level", (F.col(amount) - before) / (total - weights))
    df = df.withColumn("_level", F.when(F.col("_level") <= F.col(cap) / F.col(weight), F.col("_level")))
    df = df.withColumn("_level", F.max("_level").over(w))  # past the right row the levels fall
    return df.withColumn(out, F.when(F.col("_level").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_level") * F.col(weight))).cast("double")).drop("_level")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size -> target. Sources by code point, null last, weigh 5, 2, 1, repeating."""
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())) - 1
    df = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.col("source_size") * most).withColumn("_all", F.sum("source_size").over(W.partitionBy(F.lit(1))) * share)
    return filled(df, [], "_all", "_cap", "_w", "target").select("source", "source_size", "target")


def uniform(*cols: Column, seed: int) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)


def _sized(docs: DataFrame) -> DataFrame:
    """docs with _size, _key, a hash of the text, and _cls, the class of its size."""
    sized = docs.withColumn("_size", F.regexp_count(text_of(), F.lit(WORD)).cast("long")).withColumn("_key", F.xxhash64("text"))
    return sized.withColumn("_cls", F.when(F.col("_size") > 0, F.floor(F.log2("_size"))).otherwise(-1).cast("int"))


def _placed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows of _sized() with source_size, target, whole and rest of their source, rank _q and its cell _cell.

    plan has a row for each source and size class, as few as the sources: adaptive execution broadcasts it where its
    written size allows.
    """
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_cls") == F.col("_pcls"))
    u, p = uniform(F.col("doc_id"), F.col("_key"), seed=seed), F.coalesce(F.col("_p"), F.lit(0.0))
    rows = rows.join(plan, on, "left").withColumn("_q", F.when(p >= 1, 0.0).when(p > 0, u / (1 - u) * (1 - p) / p))
    return rows.withColumn("_cell", F.when(F.col("_q").isNotNull() & (F.col("_rest") > 0), F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS).cast("int"))).drop("_source", "_pcls", "_p", "_cls")


def _plan(base: DataFrame, share: float, most: float, weights: tuple) -> DataFrame:
    """_source, _pcls -> _source_size, _target, _whole copies, _rest in words, and the inclusion probability _p."""
    classes = base.groupBy("source", "_cls").agg(F.sum("_size").alias("cap"))
    sources = targets(classes.groupBy("source").agg(F.sum("cap").alias("source_size")), share, most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("_whole", F.floor(ratio + 1e-9).cast("long")).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    sources = sources.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_whole", "_rest")
    every = classes.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("source").withColumn("cap", F.col("cap").cast("double"))
    some = every.where("_cls >= 0").withColumn("_w", F.col("cap") * F.pow(F.lit(2.0), F.col("_cls") * -TEMPER))
    some = filled(some, ["_source"], "_rest", "cap", "_w", "_in").withColumn("_p", F.col("_in") / F.col("cap")).drop("_in", "_w")
    return saved(some.unionByName(every.where("_cls < 0").withColumn("_p", F.lit(0.0))).withColumnRenamed("_cls", "_pcls").drop("cap"), "plan")


def _cuts(rows: DataFrame) -> DataFrame:
    """_csource -> the cell at its source's cut, and the words of the cells before it."""
    cells = rows.where("_cell is not null").groupBy("source", "_cell", "_rest").agg(F.sum("_size").alias("n"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return saved(cells.where("_before < _rest").groupBy(F.col("source").alias("_csource")).agg(F.max("_cell").alias("_cut"), F.max("_before").alias("_before")), "cuts")


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with _copies. Only the rows of the cells at the cuts are ordered."""
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("_csource")), "left").drop("_csource")
    sure = rows.where("_cell is null or _cut is null or _cell <> _cut").withColumn("_extra", F.coalesce(F.col("_cell") < F.col("_cut"), F.lit(False)))
    run = F.coalesce(F.sum("_size").over(W.partitionBy("source").orderBy("_q", "doc_id", "_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where("_cell = _cut").withColumn("_extra", F.col("_before") + run + F.col("_size") / 2 <= F.col("_rest"))
    return sure.unionByName(edge).withColumn("_copies", F.col("_whole") + F.col("_extra").cast("long"))


def _sample(docs: DataFrame, share: float, most: float, weights: tuple, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = saved(_sized(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    plan = _plan(base, share, most, weights)
    rows = _placed(base, plan, seed)
    return rows, plan, _cuts(rows)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 17) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, key (the row's hash).

    Null text has size 0, and null is a source of its own. Texts without words get the whole copies of their source.
    Rows alike in doc_id, source and text tie; which of them enters makes no difference. Reruns agree: all
    randomness is a hash of doc_id and text. An empty table gives no rows; other columns are ignored.
    """
    rows, _, cuts = _sample(docs, share, most, weights, seed)
    return _taken(rows, cuts).select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), F.col("_key").alias("key"))


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 17) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with the columns of docs.

    Copies are decided where a document is read, from the tables of plan and cuts; of the texts only those of the
    cells at the cuts, a 4096th of a source's order, are shuffled. Columns of docs keep their names and values,
    whatever they are.
    """
    _, plan, cuts = _sample(docs, share, most, weights, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = _sized(docs.select("doc_id", "source", "text", row)).drop("text")
    taken = _taken(_placed(own, plan, seed), cuts).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
