"""Who may do what: principals, certificates, rules, admission in order, and rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns

PART = r"^[^/\s]+$"
#: Limits of a request: id, batch, record and batch bytes.
LIMITS = {"request_id": 256, "batch": 1024, "record_bytes": 16 << 20, "batch_bytes": 64 << 20}


def principals(rows: DataFrame) -> DataFrame:
    """rows (tenant, service, instance or null) with valid and producer; a part is not empty, without slash or space."""
    ok = lambda c: F.coalesce(F.col(c).rlike(PART), F.lit(False))
    valid = ok("tenant") & ok("service") & (F.col("instance").isNull() | ok("instance"))
    return rows.withColumn("valid", valid).withColumn("producer", F.when(valid, columns.producer(F.col("tenant"), F.col("service"), F.col("instance"))))


def certified(certificates: DataFrame, names: DataFrame) -> DataFrame:
    """(certificate, principal, outcome) from certificates (certificate, uri) and names (uri, principal): exactly one
    principal for all names of a certificate, else AMBIGUOUS, or UNKNOWN without any."""
    per = certificates.join(names, "uri", "left").groupBy("certificate").agg(F.count_distinct("principal").alias("n"), F.min("principal").alias("principal"))
    outcome = F.when(F.col("n") == 1, "OK").when(F.col("n") == 0, "UNKNOWN").otherwise("AMBIGUOUS")
    return per.select("certificate", F.when(F.col("n") == 1, F.col("principal")).alias("principal"), outcome.alias("outcome"))


def authorized(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests with allowed. A rule (tenant, service, instance or null for any, namespace, prefix, operations) allows a
    request if all are equal, the stream begins with the prefix and the operation is among its operations; else no.

    Prefixes of one tenant, service and namespace meet the streams by their beginnings: each request names the
    beginnings of its stream that are as long as some prefix of its key, so the join is on equal values.
    """
    key = ["tenant", "service", "namespace"]
    lengths = rules.groupBy(*key).agg(F.array_distinct(F.collect_list(F.length("prefix"))).alias("_lengths"))
    asked = requests.select(*key, "instance", "stream", "operation").distinct().join(lengths, key)
    asked = asked.withColumn("_n", F.explode("_lengths")).where("length(stream) >= _n").withColumn("prefix", F.expr("substring(stream, 1, _n)"))
    flat = rules.select(*key, F.col("instance").alias("_instance"), "prefix", F.explode("operations").alias("operation"))
    yes = asked.join(flat, [*key, "prefix", "operation"]).where("_instance is null or _instance = instance")
    yes = yes.select(*key, "instance", "stream", "operation").distinct().withColumn("_yes", F.lit(True)).alias("y")
    on = F.lit(True)
    for c in (*key, "instance", "stream", "operation"):
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"y.{c}"))
    return requests.alias("r").join(yes, on, "left").select("r.*", F.coalesce("_yes", F.lit(False)).alias("allowed"))


def admitted(requests: DataFrame, mode: str = "SINGLE_SYNC", limits: dict = LIMITS) -> DataFrame:
    """requests with outcome: the first check that fails, in order, or OK.

    Columns: draining, namespace, stream, request_id, durability, allowed, record_count, largest_record, bytes.
    """
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    checks: list[tuple[Column, str]] = [
        (F.col("draining"), "REPLICA_UNAVAILABLE"),
        (empty("namespace") | empty("stream"), "INVALID_ARGUMENT"),
        (empty("request_id") | (F.octet_length("request_id") > limits["request_id"]), "INVALID_ARGUMENT"),
        (~F.col("durability").isin("UNSPECIFIED", "SINGLE_SYNC", mode), "DURABILITY_UNAVAILABLE"),
        (~F.col("allowed"), "PERMISSION_DENIED"),
        (F.col("record_count") < 1, "INVALID_ARGUMENT"),
        (F.col("record_count") > limits["batch"], "RESOURCE_EXHAUSTED"),
        (F.col("largest_record") > limits["record_bytes"], "RECORD_TOO_LARGE"),
        (F.col("bytes") > limits["batch_bytes"], "RESOURCE_EXHAUSTED"),
    ]
    outcome = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), name) for c, name in checks], F.lit("OK"))
    return requests.withColumn("outcome", outcome)


def rate_limited(requests: DataFrame, per_second: float, burst: float) -> DataFrame:
    """(arrival, key, admitted) by a token bucket for each key: tokens return with time, up to burst, and a request that
    costs more than there are is refused and takes none. requests has key, arrival, time_us and cost.

    Requests are partitioned by key and sorted by arrival; a task walks its rows once and holds one bucket, so memory
    doesn't grow with a key's requests. The order within one key is the semantics, so one task walks it.
    """

    def walk(batches):
        key, tokens, last = object(), burst, 0
        for pdf in batches:
            ok = []
            for k, t, c in zip(pdf["key"], pdf["time_us"], pdf["cost"]):
                if k != key:
                    key, tokens, last = k, burst, t
                tokens, last = min(burst, tokens + max(0, t - last) * per_second / 1e6), max(last, t)
                ok.append(c <= tokens)
                tokens -= c if ok[-1] else 0
            yield pd.DataFrame({"arrival": pdf["arrival"], "key": pdf["key"], "admitted": ok})

    rows = requests.select("key", "arrival", "time_us", F.col("cost").cast("double").alias("cost"))
    return rows.repartition("key").sortWithinPartitions("key", "arrival").mapInPandas(walk, "arrival long, key string, admitted boolean")
