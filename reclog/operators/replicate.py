"""Replication between two logs: receiving, committing whole batches, terms, plans, promotion and rejoining.

A status row has nullable positions: local_durable, replicated, committed, applied, earliest (the first entry that a
log retains), snapshot, and term. Decisions are columns over such rows; comparisons of logs are joins by entry id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .log import whole_batches
from .ordered import running


def receive(standby: DataFrame, incoming: DataFrame) -> DataFrame:
    """(entry_id, outcome) of incoming entries: DUPLICATE, DIVERGED, ACCEPTED, or GAP from the first hole on.

    Entries that the standby holds must agree in checksum. Beyond its last entry each one must follow the one before,
    by id and by checksum; the first that doesn't stops all that come after it.
    """
    end = standby.agg(F.coalesce(F.max("entry_id"), F.lit(-1)).alias("_end"), F.coalesce(F.max_by("checksum", "entry_id"), F.lit(0)).alias("_mark"))  # one row
    own = standby.select("entry_id", F.col("checksum").alias("_own"))
    before = incoming.select((F.col("entry_id") + 1).alias("entry_id"), F.col("checksum").alias("_before"))
    j = incoming.join(own, "entry_id", "left").join(before, "entry_id", "left").join(F.broadcast(end))
    before_it = F.when(F.col("entry_id") == F.col("_end") + 1, F.col("_mark")).otherwise(F.col("_before"))
    j = j.withColumn("_follows", F.coalesce(before_it == F.col("previous_checksum"), F.lit(False)) | (F.col("entry_id") <= F.col("_end")))
    stop = j.where(~F.col("_follows")).agg(F.min("entry_id").alias("_stop"))  # one row
    outcome = F.when(F.col("entry_id") <= F.col("_end"), F.when(F.col("_own") == F.col("checksum"), "DUPLICATE").otherwise("DIVERGED")).when(F.coalesce(F.col("entry_id") >= F.col("_stop"), F.lit(False)), "GAP").otherwise("ACCEPTED")
    return j.join(F.broadcast(stop)).select("entry_id", outcome.alias("outcome"))


def visible(log: DataFrame, committed: int) -> DataFrame:
    """Entries up to a commit position; a batch that it would split stays out whole."""
    split = whole_batches(log).where((F.col("first_entry_id") <= committed) & (F.col("last_entry_id") > committed)).select("stream", F.col("first_sequence").alias("_first"))
    part = log.where(F.col("entry_id") <= committed).withColumn("_first", F.col("sequence") - F.col("batch_index"))
    return part.join(split, ["stream", "_first"], "left_anti").drop("_first")


def catch_up(primary: DataFrame, standby_last: int, max_entries: int, max_bytes: int) -> DataFrame:
    """The next range to copy to a standby, within budgets."""
    part = primary.where((F.col("entry_id") > standby_last) & (F.col("entry_id") <= standby_last + max_entries))
    run = F.sum("frame_len").over(W.partitionBy(F.lit(1)).orderBy("entry_id").rowsBetween(W.unboundedPreceding, 0))  # max_entries rows
    return part.withColumn("_run", run).where(F.col("_run") <= max_bytes).drop("_run")


def differences(primary: DataFrame, standby: DataFrame) -> DataFrame:
    """(entry_id, fault) where the standby lacks an entry of the shared range, or holds another one."""
    end = standby.agg(F.max("entry_id").alias("_end"))  # one row
    j = primary.join(F.broadcast(end)).where("entry_id <= _end").join(standby.select("entry_id", F.col("checksum").alias("_own")), "entry_id", "left")
    fault = F.when(F.col("_own").isNull(), "MISSING").when(F.col("_own") != F.col("checksum"), "DIVERGED")
    return j.select("entry_id", fault.alias("fault")).where("fault is not null")


def terms(messages: DataFrame) -> DataFrame:
    """messages (arrival, term) with what becomes of each: STALE below a term seen before, NEWER, or SAME."""
    seen = running(messages.withColumn("_next", F.col("arrival") + 1), "term", "_seen", "arrival", how="max")
    before = seen.select(F.col("_next").alias("arrival"), F.col("_seen").alias("_before"))
    j = seen.select("arrival", "term").join(before, "arrival", "left")
    verdict = F.when(F.col("_before").isNull() | (F.col("term") > F.col("_before")), "NEWER").when(F.col("term") < F.col("_before"), "STALE").otherwise("SAME")
    return j.select("arrival", "term", verdict.alias("verdict"))


def planned(status: DataFrame) -> DataFrame:
    """status with plan and start_entry: INCREMENTAL where the log still holds what the standby lacks, else SNAPSHOT
    where there is one that the log goes on from, else ERROR."""
    want = F.coalesce(F.col("local_durable") + 1, F.lit(0).cast("long"))
    by_log, by_snapshot = want >= F.col("earliest"), F.col("snapshot").isNotNull() & (F.col("snapshot") + 1 >= F.col("earliest"))
    return status.withColumn("plan", F.when(by_log, "INCREMENTAL").when(by_snapshot, "SNAPSHOT").otherwise("ERROR")).withColumn("start_entry", F.when(by_log, want).when(by_snapshot, F.col("snapshot") + 1))


def rejoining(status: DataFrame) -> DataFrame:
    """status with decision: INCREMENTAL if the old primary's log is a prefix of the new one's; SNAPSHOT, discarding
    its suffix, if nothing committed is in it; FAIL otherwise. shared is the last entry on which both agree."""
    same = F.coalesce(F.col("local_durable") <= F.col("shared"), F.lit(True))
    return status.withColumn("decision", F.when(same, "INCREMENTAL").when(F.coalesce(F.col("committed") <= F.col("shared"), F.lit(True)), "SNAPSHOT").otherwise("FAIL"))


def lags(status: DataFrame) -> DataFrame:
    gap = lambda a, b: F.greatest(F.coalesce(F.col(a) - F.col(b), F.lit(0)), F.lit(0)).cast("long")
    return status.withColumn("replication_lag", gap("local_durable", "replicated")).withColumn("apply_lag", gap("committed", "applied"))


def acknowledged(acks: DataFrame) -> DataFrame:
    """The commit position after each durable acknowledgement (arrival, node, entry_id): the least of what the primary
    and the standby have made durable so far; null until both have."""
    one = lambda n: running(acks.withColumn("_e", F.when(F.col("node") == n, F.col("entry_id"))), "_e", f"_{n}", "arrival", how="max").select("arrival", f"_{n}")
    j = one("primary").join(one("standby"), "arrival")
    return j.select("arrival", F.when(F.col("_primary").isNotNull() & F.col("_standby").isNotNull(), F.least("_primary", "_standby")).alias("committed"))


def promotion_faults(suffix: DataFrame, tails: DataFrame) -> DataFrame:
    """(stream, first_sequence, fault) of the batches of an uncommitted suffix that a promotion can't take over: not
    whole, or not going on from the stream's tail or the batch before it."""
    b = whole_batches(suffix)
    end = b.select("stream", (F.col("first_sequence") + F.col("batch_count")).alias("first_sequence"), F.lit(True).alias("_on"))
    j = b.join(end, ["stream", "first_sequence"], "left").join(tails.select("stream", F.col("next_sequence").alias("_tail")), "stream", "left")
    goes_on = F.col("_on").isNotNull() | (F.col("first_sequence") == F.coalesce(F.col("_tail"), F.lit(0)))
    fault = F.when(~F.col("complete"), "PARTIAL").when(~goes_on, "GAP")
    return j.select("stream", "first_sequence", fault.alias("fault")).where("fault is not null")


def promoted(status: DataFrame) -> DataFrame:
    """Status after promotion: every position becomes the last local one, and the term rises."""
    last = F.col("local_durable")
    return status.select("name", (F.col("term") + 1).alias("term"), *[last.alias(c) for c in ("local_durable", "replicated", "committed", "applied")])


def recovery_task(status: DataFrame) -> DataFrame:
    """status with action and task_id: the same facts give the same id, so a task that is asked for twice is one."""
    action = F.when(F.col("plan") == "INCREMENTAL", "COPY").when(F.col("snapshot").isNotNull() & (F.col("snapshot") + 1 >= F.col("earliest")), "INSTALL").otherwise("CREATE_AND_INSTALL")
    facts = F.concat_ws("|", "name", F.col("term").cast("string"), F.coalesce(F.col("local_durable").cast("string"), F.lit("-")), F.coalesce(F.col("snapshot").cast("string"), F.lit("-")), action)
    return status.withColumn("action", action).withColumn("task_id", F.sha2(facts, 256))


#: Rules of a status row: name and the condition that must hold where its columns are present.
STATE_RULES = (
    ("applied_after_committed", "applied <= committed"),
    ("committed_after_durable", "committed <= local_durable"),
    ("committed_after_replicated", "role <> 'PRIMARY' OR replicated IS NULL OR committed <= replicated"),
    ("replicated_after_durable", "replicated <= local_durable"),
    ("snapshot_covers_collected", "earliest = 0 OR (snapshot IS NOT NULL AND snapshot + 1 >= earliest)"),
    ("standby_has_no_replica", "role <> 'STANDBY' OR replicated IS NULL"),
    ("term_is_set", "term >= 1"),
)


def state_faults(status: DataFrame) -> DataFrame:
    """(name, rule) of each rule that a status row breaks; a rule over an absent position holds."""
    return status.select("name", F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(True)), F.lit(n)) for n, r in STATE_RULES]))).alias("rule"))


def state_chain_faults(states: DataFrame) -> DataFrame:
    """(generation, fault) of stored states: a generation without its predecessor, with another digest than the one it
    names, or with a position that falls."""
    was = states.select((F.col("generation") + 1).alias("generation"), F.col("digest").alias("_digest"), *[F.col(c).alias(f"_{c}") for c in ("committed", "applied", "term", "earliest")])
    j = states.join(was, "generation", "left")
    fell = F.lit(False)
    for c in ("committed", "applied", "term", "earliest"):
        fell = fell | F.coalesce(F.col(c) < F.col(f"_{c}"), F.lit(False))
    fault = F.when((F.col("generation") > 1) & F.col("_digest").isNull(), "MISSING").when(F.col("_digest") != F.col("previous_digest"), "DIGEST").when(fell, "FELL")
    return j.select("generation", fault.alias("fault")).where("fault is not null")
