"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row for each digest, joined to the
index by a sort-merge anti-join in which the index side needs no exchange, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import saved, scratch, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(name: str = "text") -> Column:
    """Null as empty; A-Z lower-cased and nothing else."""
    return F.translate(text_of(name), UPPER, LOWER)


class DigestIndex:
    """A persistent index: digest, keep_id, group_size, one row for each distinct text.

    Group size counts the rows of the batch that brought the text. An empty table makes an empty index. A path that
    holds an index is opened with the buckets that it was made with, whichever are asked for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, (path or scratch(spark, "digests")).rstrip("/"), buckets
        self.table = f"digests_{uuid.uuid4().hex}"
        self.empty = path is None or not self._opened()

    def _opened(self) -> bool:
        """Whether the path holds an index, which is then registered with its buckets."""
        try:
            schema = self.spark.read.parquet(self.path).schema
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        self.buckets = self.spark.read.parquet(f"{self.path}-buckets").first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return True

    def _append(self, rows: DataFrame) -> None:
        if self.empty:  # the number of buckets comes first: an index without it can't be opened
            self.spark.range(1).selectExpr(f"{self.buckets} AS buckets").write.mode("overwrite").parquet(f"{self.path}-buckets")
        # The parts of the shuffle match the buckets, so each task writes one file a bucket.
        out = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
        out.mode("overwrite" if self.empty else "append").option("path", self.path).format("parquet").saveAsTable(self.table)
        self.empty = False

    def read(self) -> DataFrame:
        """As a bucketed table: joins on digest need no exchange on this side."""
        return self.spark.table(self.table)

    def read_plain(self) -> DataFrame:
        """Without the buckets, so that adaptive execution may split a hot digest in a join."""
        return self.spark.read.schema(self.read().schema).parquet(self.path)

    def add(self, hashed: DataFrame, id_col: str = "doc_id") -> None:
        """Append the digests that the index lacks. Of a batch's equal texts, the largest id stays."""
        groups = hashed.groupBy("digest").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"))
        self._append(groups if self.empty else groups.join(self.read().hint("merge"), "digest", "left_anti"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col), F.unhex(F.sha2(F.encode(normalised(text_col), "utf-8"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, digest.

    Null text equals the empty text. A row is kept if its id is the index's keep_id; a text that an earlier batch
    brought keeps that batch's row. Rows alike in id and text are one document and share their decision. A group
    of null ids keeps null. Other columns are ignored, so their names can't clash; an empty table gives no rows.
    """
    index = index or DigestIndex(docs.sparkSession)
    hashed = saved(digests(docs, id_col, text_col), "hashed")
    index.add(hashed, id_col)
    joined = hashed.join(index.read_plain(), "digest")
    return joined.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in two batches, the larger ids first, so that the largest id of a text is the one kept; null ids
    come last. Group sizes are those of both batches."""
    hashed = saved(digests(spark.read.parquet(f"{sf_dir}/documents.parquet")), "hashed")
    middle = hashed.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    first = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    path = scratch(spark, "digests")
    for batch in (hashed.where(first), hashed.where(~first)):
        index = DigestIndex(spark, path)  # opened again, as by a later run
        index.add(batch)
    sizes = hashed.groupBy("digest").agg(F.count("*").alias("group_size"))
    kept = index.read_plain().select("digest", "keep_id").join(sizes, "digest")
    found = hashed.join(kept, "digest")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = f"""
WITH h AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, h.text_sha256
FROM h JOIN g USING (text_sha256)
"""
