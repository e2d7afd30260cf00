"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates come from patterns. The hash of each candidate's value is counted over the corpus by distinct
repositories and owners: a value that several owners publish is a widely copied example, a value that one owner
alone has looks live.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import saved, text_of

# Kind, pattern, group that holds the value, least length of the value. Where only the whole match is
# measured, the length stands in the pattern: runs are maximal, so this finds the same spans.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds of the method's own, reported only where ownership says that they look live.
MORE = (
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----", 0, 60),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)
#: A value of so many owners at least is a copied example.
EXAMPLE_OWNERS = 3
#: Matches of a text that are placed together.
RUN = 256


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind, value) in code points: the gaps between matches give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # Starting from the n-th gap, the n-th match begins where gaps and matches before it end.
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), value.alias("value"))
    kinds = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["hit"])
        item = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(keep, F.concat(a["out"], F.array(item))).otherwise(a["out"]).cast(kinds).alias("out"))

    def places(runs: Column, sizes: Column) -> Column:
        start = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n)
        zero = lambda i: F.struct(start(i).alias("at"), F.array().cast(kinds).alias("out"))
        return F.flatten(F.transform(runs, lambda run, i: F.aggregate(run, zero(i), step, lambda a: a["out"])))

    width = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0)))
    spans = _with(_runs(parts), lambda runs: _with(F.transform(runs, width), lambda sizes: places(runs, sizes)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kinds))


def _with(value: Column, body) -> Column:
    """body(value), the value being computed once and not for each place in body that names it."""
    return F.transform(F.array(value), body)[0]


def _runs(parts: Column) -> Column:
    """parts in runs of RUN: an array that grows by appending only grows to a run, so long texts take no square of work."""
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: F.slice(p, i * RUN + 1, F.lit(RUN)))
    return _with(parts, cut)


def candidates(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Each row with its base and further spans: row, id, repo, owner, base, more."""
    text = F.col("_text")
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), text_of().alias("_text"))
    base = F.concat(*[_spans(text, k, i, *x) for i, (k, *x) in enumerate(BASE)])
    more = F.concat(*[_spans(text, k, len(BASE) + i, *x) for i, (k, *x) in enumerate(MORE)])
    return df.select("row", "doc_id", "repo", "owner", F.sort_array(base).alias("base"), F.sort_array(more).alias("more"))


def ownership(spans: DataFrame) -> DataFrame:
    """digest, repos, owners, class of each value. Copies count once by owner and repository, before any value meets."""
    pairs = spans.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    stats = owners.groupBy("digest").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.sum("n").alias("hits"))
    return stats.withColumn("class", F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(F.col("owners") == 1, "live").otherwise("shared"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, base and all spans with values, and the counts of live, shared and example values.

    Null text is empty and has no spans; null repositories and owners count as one of their own. Repeated rows each
    get their result. A span belongs to each kind whose pattern finds it; overlaps between kinds stay. An empty
    table gives no rows; other columns are ignored.
    """
    rows = saved(candidates(docs, repo, owner), "secrets")
    each = rows.select("row", "repo", "owner", F.explode(F.concat("base", "more")).alias("x"))
    each = each.select("row", "repo", "owner", "x", F.unhex(F.sha2(F.col("x.value"), 256)).alias("digest"))
    owned = each.join(ownership(each), "digest")
    count = lambda c: F.count(F.when(F.col("class") == c, 1)).alias(f"n_{c}")
    extra = F.collect_list(F.when((F.col("x.rank") >= len(BASE)) & (F.col("class") == "live"), F.col("x"))).alias("live_more")
    by_row = owned.groupBy("row").agg(count("live"), count("shared"), count("example"), F.max("owners").alias("most_owners"), extra)
    out = rows.join(by_row, "row", "left")
    every = F.sort_array(F.concat("base", F.coalesce("live_more", F.array().cast(out.schema["base"].dataType))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "base", every.alias("every"), zero("n_live"), zero("n_shared"), zero("n_example"), zero("most_owners"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k, *_ in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), "n_live", "n_shared", "n_example", "most_owners")


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """SELECT of the spans of one kind, in DuckDB: gaps between matches give their places, as in _spans()."""
    # DuckDB folds letters past ASCII under (?i); classes of both cases stay within it. Its \s leaves out \x0B.
    if pattern.startswith("(?i)"):
        keys, rest = pattern[4:].split(")", 1)
        pattern = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", keys) + ")" + rest
    quoted = pattern.replace("\\s", "\\t-\\r\\x20").replace("'", "''")
    return f"""
        SELECT row, {rank} AS rank, '{kind}' AS kind, start, start + length(hit) AS stop, value FROM (
            SELECT row, hit, value, (sum(length(gap) + length(hit)) OVER (PARTITION BY row ORDER BY n) - length(hit))::BIGINT AS start FROM (
                SELECT row, generate_subscripts(hits, 1) AS n, unnest(hits) AS hit, unnest(texts) AS value, unnest(gaps[:len(hits)]) AS gap FROM (
                    SELECT row, regexp_extract_all(text, '{quoted}') AS hits, regexp_extract_all(text, '{quoted}', {group}) AS texts, string_split_regex(text, '{quoted}') AS gaps
                    FROM docs WHERE regexp_matches(text, '{quoted}'))))
        WHERE length(value) >= {least}"""


OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_kind_sql(i, k, *x) for i, (k, *x) in enumerate((*BASE, *MORE)))}),
owners AS (
    SELECT value, count(DISTINCT coalesce('s' || source, 'null')) AS owners
    FROM spans JOIN docs USING (row) GROUP BY value),
classed AS (
    SELECT spans.*, owners, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS class,
        kind || ':' || start || ':' || stop AS span, rank < {len(BASE)} AS base
    FROM spans JOIN owners USING (value)),
found AS (
    SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in BASE)},
        string_agg(span, ',' ORDER BY start, rank) FILTER (base) AS base,
        string_agg(span, ',' ORDER BY start, rank) FILTER (base OR class = 'live') AS spans,
        {", ".join(f"count(*) FILTER (class = '{c}') AS n_{c}" for c in ("live", "shared", "example"))}, max(owners) AS most_owners
    FROM classed GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_live", "n_shared", "n_example", "most_owners"))}
FROM docs LEFT JOIN found USING (row)
"""
