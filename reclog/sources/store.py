"""Stored records: Parquet segments, their extents, and a manifest whose generations follow each other by hash.

Everything lies below one root that driver and executors share, on any file system that Spark reads. A segment is
written whole before a manifest names it, and a generation's file is created, never replaced: of two publishers of one
generation the second fails. Reading takes one generation and doesn't see later ones.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintain, reads


class StoreError(Exception):
    pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Unset, a local master gets a temporary folder; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reclog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class RecordStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # Manifest

    def generations(self) -> list[int]:
        if not self._fs.exists(self._path("manifest")):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._path("manifest")) if f.getPath().getName().isdigit())

    def _raw(self, generation: int) -> str:
        rows = self.spark.read.text(f"{self.root}/manifest/{generation:020d}", wholetext=True).collect()  # one small file
        return rows[0]["value"]

    def manifest(self, generation: int | None = None) -> dict:
        """A generation, the newest if not told which; an empty one of number 0 if there is none yet."""
        known = self.generations()
        if not known:
            return {"generation": 0, "segments": [], "last_entry_id": -1, "record_count": 0, "batches": [], "previous_sha256": ""}
        at = known[-1] if generation is None else generation
        if at not in known:
            raise StoreError(f"no generation {at}")
        raw = self._raw(at)
        found = json.loads(raw)
        if found["generation"] != at or hashlib.sha256(raw.encode()).hexdigest() != self._seal(at):
            raise StoreError(f"generation {at} differs from its seal")
        return found

    def _seal(self, generation: int) -> str:
        return self.spark.read.text(f"{self.root}/manifest/{generation:020d}.sha256").first()["value"]

    def _create(self, name: str, text: str) -> None:
        """Write a new file; fails if it is there."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:  # py4j wraps what the file system raises
            raise StoreError(f"{name} was published by another") from e
        out.write(text.encode())
        out.close()

    def publish(self, now: dict, segments: list[dict], last_entry_id: int, batch: str | None = None) -> dict:
        """The generation after `now`. Raises StoreError if another took its number, or if the last entry would fall."""
        if last_entry_id < now["last_entry_id"]:
            raise StoreError("the last entry would fall")
        new = {
            "generation": now["generation"] + 1, "previous_generation": now["generation"], "previous_sha256": self._seal(now["generation"]) if now["generation"] else "",
            "segments": segments, "last_entry_id": last_entry_id, "record_count": sum(s["record_count"] for s in segments),
            "batches": [*now["batches"], batch][-1000:] if batch is not None else now["batches"],
        }
        raw = json.dumps(new, sort_keys=True)
        self._create(f"manifest/{new['generation']:020d}.sha256", hashlib.sha256(raw.encode()).hexdigest())
        self._create(f"manifest/{new['generation']:020d}", raw)  # from here on it is visible
        return new

    def verify_chain(self) -> int:
        """How many generations are there, each sealed and each naming the seal of the one before it."""
        known = self.generations()
        for a, b in zip(known, known[1:]):
            if b != a + 1 or self.manifest(b)["previous_sha256"] != self._seal(a):
                raise StoreError(f"generation {b} doesn't follow {a}")
        if known:
            self.manifest(known[0])
        return len(known)

    # Segments

    def _write(self, records: DataFrame) -> dict:
        """A segment sorted by stream and sequence, and its extents. Range partitions split a hot stream."""
        name = f"segments/{uuid.uuid4().hex}"
        records.repartitionByRange("stream", "sequence").sortWithinPartitions("stream", "sequence").write.parquet(f"{self.root}/{name}")
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        own = reads.extents(rows.withColumn("segment_id", F.lit(name)))
        own.write.parquet(f"{self.root}/extents/{name.rsplit('/', 1)[1]}")
        t = rows.agg(F.count("*").alias("n"), F.min("entry_id").alias("a"), F.max("entry_id").alias("b"), F.coalesce(F.sum("frame_len"), F.lit(0)).alias("bytes")).first()
        return {"path": name, "record_count": t["n"], "first_entry_id": t["a"], "last_entry_id": t["b"], "bytes": t["bytes"]}

    def append(self, records: DataFrame, batch: str) -> dict:
        """Add committed records as one segment. A batch that the manifest names already changes nothing, so a stream's
        foreachBatch may give it again after a failure."""
        now = self.manifest()
        if batch in now["batches"]:
            return now
        new = self._write(records)
        if not new["record_count"]:
            return self.publish(now, now["segments"], now["last_entry_id"], batch)
        if new["first_entry_id"] <= now["last_entry_id"]:
            raise StoreError("entries come before the last one")
        return self.publish(now, [*now["segments"], new], new["last_entry_id"], batch)

    def scan(self, generation: int | None = None, paths: list[str] | None = None) -> DataFrame:
        """Records of a generation."""
        names = [s["path"] for s in self.manifest(generation)["segments"]] if paths is None else paths
        if not names:
            raise StoreError("no segment")
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in names])

    def extents(self, generation: int | None = None) -> DataFrame:
        """Extents of a generation; made again from the records where their files are gone or damaged."""
        names = [s["path"] for s in self.manifest(generation)["segments"]]
        try:
            return self.spark.read.parquet(*[f"{self.root}/extents/{n.rsplit('/', 1)[1]}" for n in names])
        except PySparkException:
            parts = [reads.extents(self.scan(paths=[n]).withColumn("segment_id", F.lit(n))) for n in names]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

    def read(self, stream: str, start: int, max_records: int, max_bytes: int, generation: int | None = None) -> DataFrame:
        """reads.read over the segments whose extents touch the range; stream and sequence are pushed to their scan."""
        own = self.extents(generation).where((F.col("stream") == stream) & (F.col("next_sequence") > start) & (F.col("first_sequence") < start + max_records))
        names = [r["segment_id"] for r in own.select("segment_id").distinct().collect()]  # of one stream's range
        every = [s["path"] for s in self.manifest(generation)["segments"]]
        return reads.read(self.scan(generation, names or every[:1]), stream, start, max_records, max_bytes)

    # Upkeep

    def _listed(self, now: dict) -> DataFrame:
        rows = [(s["path"], s["first_entry_id"], s["last_entry_id"], s["bytes"]) for s in now["segments"]]
        return self.spark.createDataFrame(rows, "segment_id string, first_entry_id long, last_entry_id long, bytes long")

    def compact(self, max_segments: int = maintain.MAX_SEGMENTS, max_bytes: int = maintain.MAX_BYTES) -> dict:
        """Rewrite the first run of adjacent segments within the bounds as one; inputs stay for readers until vacuum().

        Raises StoreError if a stream of the inputs has a gap: then nothing is published.
        """
        now = self.manifest()
        chosen = [r["segment_id"] for r in maintain.compaction_inputs(self._listed(now), max_segments, max_bytes).collect()] if now["segments"] else []
        if not chosen:
            return now
        inputs = self.spark.createDataFrame([(c,) for c in chosen], "segment_id string")
        source = self.scan(paths=chosen).drop("segment_id")
        tagged = source.withColumn("segment_id", F.lit(chosen[0]))
        if not maintain.merged(tagged, inputs.limit(1)).where("not continuous").isEmpty():
            raise StoreError("a stream of the inputs has a gap")
        new = self._write(self.scan(paths=chosen))
        at = min(i for i, s in enumerate(now["segments"]) if s["path"] in chosen)
        left = [s for s in now["segments"] if s["path"] not in chosen]
        return self.publish(now, [*left[:at], new, *left[at:]], now["last_entry_id"])

    def vacuum(self, pinned: list[int] = ()) -> list[str]:
        """Delete segments that neither the current generation nor a pinned one names; their paths."""
        keep = {s["path"] for g in (None, *pinned) for s in self.manifest(g)["segments"]}
        root = self._path("segments")
        there = [f"segments/{f.getPath().getName()}" for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        gone = sorted(p for p in there if p not in keep)
        for p in gone:
            self._fs.delete(self._path(p), True)
            self._fs.delete(self._path(f"extents/{p.rsplit('/', 1)[1]}"), True)
        return gone

    def snapshot(self, to: str, generation: int | None = None) -> RecordStore:
        """A copy of a generation at another root: its segments by Spark, then its manifest, so a copy that was cut off
        holds no generation."""
        now, other = self.manifest(generation), RecordStore(self.spark, to)
        if other.generations():
            raise StoreError("the target holds a store")
        for s in now["segments"]:
            self.scan(paths=[s["path"]]).write.mode("overwrite").parquet(f"{other.root}/{s['path']}")
            own = s["path"].rsplit("/", 1)[1]
            self.spark.read.parquet(f"{self.root}/extents/{own}").write.mode("overwrite").parquet(f"{other.root}/extents/{own}")
        other.publish(other.manifest(), now["segments"], now["last_entry_id"], f"snapshot-{now['generation']}")
        return other

    def verify(self, generation: int | None = None) -> DataFrame:
        """(path, fault) of segments whose records differ from the manifest: MISSING, COUNT, BYTES or ENTRIES."""
        now, found = self.manifest(generation), []
        for s in now["segments"]:
            if not self._fs.exists(self._path(s["path"])):
                found.append((s["path"], "MISSING"))
        gone = {p for p, _ in found}
        out = self.spark.createDataFrame(found, "path string, fault string")
        rest = [s for s in now["segments"] if s["path"] not in gone]
        if rest:
            said = self.spark.createDataFrame([(s["path"], s["record_count"], s["bytes"], s["first_entry_id"], s["last_entry_id"]) for s in rest], "path string, n long, bytes long, a long, b long")
            rows = self.scan(paths=[s["path"] for s in rest]).select(F.concat(F.lit("segments/"), F.regexp_extract(F.input_file_name(), "segments/([^/]+)/", 1)).alias("path"), "entry_id", "frame_len")
            own = rows.groupBy("path").agg(F.count("*").alias("_n"), F.sum("frame_len").alias("_bytes"), F.min("entry_id").alias("_a"), F.max("entry_id").alias("_b"))
            fault = F.when(F.coalesce("_n", F.lit(0)) != F.col("n"), "COUNT").when(F.col("_bytes") != F.col("bytes"), "BYTES").when((F.col("_a") != F.col("a")) | (F.col("_b") != F.col("b")), "ENTRIES")
            out = out.unionByName(said.join(own, "path", "left").select("path", fault.alias("fault")).where("fault is not null"))
        return out

    def identity(self, node: str | None = None) -> str:
        """The name of the root's node, given once and never changed; without a name, the one that it has."""
        path = self._path("identity")
        if not self._fs.exists(path):
            if not node:
                raise StoreError("the root has no identity")
            self._create("identity", json.dumps({"node": node}))
        own = json.loads(self.spark.read.text(f"{self.root}/identity", wholetext=True).first()["value"])["node"]
        if node is not None and own != node:
            raise StoreError(f"the root belongs to {own}")
        return own

    def install(self, source: str) -> dict:
        """Replace what the root holds by another store's current generation. The source is noted first, so that
        resume_install() can finish an install that was cut off; nothing is visible before all is copied. An install
        that would take back committed entries is refused."""
        other = RecordStore(self.spark, source)
        theirs, now = other.manifest(), self.manifest()
        if theirs["last_entry_id"] < now["last_entry_id"]:
            raise StoreError("the snapshot ends before what is committed here")
        if not other.verify().isEmpty():
            raise StoreError("the snapshot is damaged")
        self._fs.delete(self._path("install"), False)
        self._create("install", json.dumps({"source": source, "after": now["generation"], "segments": theirs["segments"], "last_entry_id": theirs["last_entry_id"]}))
        return self.resume_install()

    def resume_install(self) -> dict:
        """Finish the install that is noted, if any. Segments are copied over what an earlier attempt left of them."""
        if not self._fs.exists(self._path("install")):
            return self.manifest()
        note = json.loads(self.spark.read.text(f"{self.root}/install", wholetext=True).first()["value"])
        now, other = self.manifest(), RecordStore(self.spark, note["source"])
        if now["generation"] == note["after"]:
            held = {s["path"] for s in now["segments"]}
            for s in note["segments"]:
                if s["path"] not in held:
                    own = s["path"].rsplit("/", 1)[1]
                    other.scan(paths=[s["path"]]).write.mode("overwrite").parquet(f"{self.root}/{s['path']}")
                    self.spark.read.parquet(f"{other.root}/extents/{own}").write.mode("overwrite").parquet(f"{self.root}/extents/{own}")
            now = self.publish(now, note["segments"], note["last_entry_id"], f"install-{note['after']}")
        self._fs.delete(self._path("install"), False)
        return now
