"""Toxicity by weak supervision.

Many voters look at a text: fixed insult lexicons, patterns, and lexicons mined from the labelled training rows.
A generative label model estimates each voter's accuracy by class and the correlations between voters; its
posteriors, not the labels, train a linear classifier over words and word beginnings, which scores every text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import prepare, text_of

# English insults by theme, one voter for each theme.
LEXICONS = (
    ("mind", "idiot moron stupid dumb imbecile fool dimwit braindead"),
    ("worth", "loser worthless pathetic useless failure nobody"),
    ("filth", "scum trash garbage filth vermin disgusting sewage"),
    ("mockery", "clown joke freak jerk creep weirdo"),
)
WORD = re.compile(r"[^\W_]+")
SHOUT = re.compile(r"[!?]{3,}")
ADDRESS = re.compile(r"\b(?:you|your|you're|ur)\b")
#: Labelled rows of either class that the model sees at most, by a hash of their id. A bound on the fit only.
SAMPLE_ROWS = 4000
MINED_VOTERS = 12
MOST_FEATURES = 20_000
#: Least z-score of a feature's log-odds between the classes.
LEAST_Z = 3.3
LIMIT = 0.7


THEME = {w: f"[{name}]" for name, x in LEXICONS for w in x.split()}


def features(word: str) -> tuple[str, ...]:
    """A word, its first four and five letters, which inflected and compounded forms share, and its lexicon."""
    own = (word, *[f"{word[:k]}*" for k in (4, 5) if len(word) >= k])
    return (*own, "[any]", THEME[word]) if word in THEME else own


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _log_odds(rows: list[np.ndarray], y: np.ndarray) -> list[tuple[int, float]]:
    """Numbers of features with the z-score of their log-odds between the classes, which may be soft."""
    every, times = np.concatenate(rows), np.repeat(y, [len(r) for r in rows])
    seen, pos = np.bincount(every), np.bincount(every, times)
    n1, n, own = y.sum(), len(y), np.nonzero(seen >= 3)[0]
    a, b = pos[own] + 0.5, seen[own] - pos[own] + 0.5
    lift = np.log(a / np.maximum(n1 - a + 1, 0.5)) - np.log(b / np.maximum(n - n1 - b + 1, 0.5))
    return list(zip(own.tolist(), (lift / np.sqrt(1 / a + 1 / b)).tolist(), strict=True))


def _votes(rows: list[np.ndarray], flags: np.ndarray, lexicons: list[set[int]], mined: list[set[int]]) -> np.ndarray:
    """Rows by voters: 1 toxic, -1 clean, 0 abstains."""
    cols = [np.array([0 if own.isdisjoint(r.tolist()) else 1 for r in rows]) for own in [*lexicons, *mined]]
    hit = np.array(cols).max(axis=0)
    cols.append(np.where(hit == 0, -1, 0))  # nothing found
    cols.append(np.where((hit > 0) & (flags[:, 0] > 0), 1, 0))  # addressed to someone
    cols.append(np.where((hit > 0) & (flags[:, 1] > 0), 1, 0))  # shouted
    return np.array(cols).T


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of toxic for each row, from expectation-maximisation over the voters.

    Each voter has a probability of each vote in each class. Voters that still agree once the class is known are
    correlated; each voter's evidence is divided by the number of votes that it so shares in, its own included.
    """
    q, n = np.clip(start, 0.02, 0.98), len(votes)
    hot = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        p1 = ((hot * q[None, :, None]).sum(1) + 0.5) / (q.sum() + 1.5)
        p0 = ((hot * (1 - q)[None, :, None]).sum(1) + 0.5) / (n - q.sum() + 1.5)
        mean = q[:, None] * ((p1[2] - p1[0])[None]) + (1 - q)[:, None] * ((p0[2] - p0[0])[None])
        rest = votes - mean
        cov = rest.T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 1)
        share = 1 / corr.sum(1)
        llr = np.log(p1) - np.log(p0)
        z = np.log(prior / (1 - prior)) + (hot * llr[:, None, :] * share[None, None]).sum((0, 2))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done, q = np.abs(new - q).max() < 1e-4, new
        if done:
            break
    return q, {"toxic": p1, "clean": p0, "correlation": corr}


def linear(found: list[np.ndarray], names: list[str], y: np.ndarray, decay: float = 1e-5, rounds: int = 1000) -> dict[str, float]:
    """Logistic regression on soft labels over the presence of features; the intercept is at ''.

    Only features that speak for toxicity enter, so no amount of other text can hide them. Both classes have the same
    weight in all, as toxic rows are few.
    """
    chosen = sorted((x for x in _log_odds(found, y) if x[1] >= LEAST_Z), key=lambda x: (-x[1], names[x[0]]))[:MOST_FEATURES]
    at = {f: i for i, (f, _) in enumerate(chosen)}
    rows = [[at[f] for f in r.tolist() if f in at] for r in found]
    col = np.fromiter((c for r in rows for c in r), dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, g2, gb2 = np.zeros(len(at)), 0.0, np.full(len(at), 1e-8), 1e-8
    even = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    even /= even.sum()
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], minlength=len(rows))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * even
        g = np.bincount(col, d[row], minlength=len(at)) + decay * w
        g2 += g * g
        gb2 += d.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * d.sum() / np.sqrt(gb2)
    return {"": b} | {names[f]: float(w[i]) for f, i in at.items()}


def _default() -> dict[str, float]:
    return {"": -2.0} | {w: 3.5 for _, x in LEXICONS for w in x.split()}


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample of labelled rows, none held out: of each class, those with the least hashes."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).withColumn("_h", F.xxhash64("doc_id"))
    take = lambda c: y.where(c).orderBy("_h", "doc_id").limit(sample_rows)
    few = take("toxic = 1").union(take("toxic <> 1"))  # at most 2 * sample_rows ids: small enough to broadcast
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row an id, however often it is repeated


def _seen(batches):
    for pdf in batches:
        text = [t.lower() for t in pdf["text"]]
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "toxic": pdf["toxic"].astype("int32"),
            "words": [" ".join(sorted(words_of(t))) for t in text],
            "address": [int(bool(ADDRESS.search(t))) for t in text], "shout": [int(bool(SHOUT.search(t))) for t in text],
        })


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """The classifier's weights by feature. Without labels of both classes the fixed lexicons decide."""
    prepare(docs.sparkSession)
    pdf = training_rows(docs, labels, sample_rows).mapInPandas(_seen, "doc_id long, toxic int, words string, address int, shout int").toPandas()
    pdf = pdf.sort_values(["doc_id", "words"]).reset_index(drop=True)
    gold = pdf["toxic"].to_numpy(dtype=float)
    if len(gold) == 0 or gold.min() == gold.max():
        return _default()
    number: dict[str, int] = {}  # rows hold numbers, and each feature's text is there once
    rows = [np.fromiter(dict.fromkeys(number.setdefault(f, len(number)) for w in x.split() for f in features(w)), np.int32) for x in pdf["words"]]
    names = list(number)
    odds = sorted((x for x in _log_odds(rows, gold) if x[1] >= LEAST_Z), key=lambda x: (-x[1], names[x[0]]))[:2000]
    mined = [{f for f, _ in odds[i::MINED_VOTERS]} for i in range(MINED_VOTERS)]
    lexicons = [{number[w] for w in x.split() if w in number} for _, x in LEXICONS]
    votes = _votes(rows, pdf[["address", "shout"]].to_numpy(), lexicons, mined)
    votes = np.column_stack([votes, np.where(gold > 0, 1, -1)])  # the label is one more voter, with an accuracy of its own
    posterior, _ = label_model(votes, gold)
    return linear(rows, names, posterior)


def score_column(model: dict[str, float], text: str = "text"):
    """score of every whole text, null and empty ones included."""
    start, weight = model[""], {f: w for f, w in model.items() if f}

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple] = {}
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            hits = set()
            for w in words_of(t):
                got = known.get(w)
                if got is None:
                    got = known[w] = tuple(f for f in features(w) if f in weight)
                if got:
                    hits.update(got)
            out[i] = start + sum(weight[f] for f in sorted(hits))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return scored(text_of(text))


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with score and predicted.

    Null text scores as the empty text, at the intercept. Repeated rows score alike. An empty table gives no rows.
    Columns of docs named score or predicted are replaced. Labels with null ids or classes don't count; of several
    labels of one id the largest counts.
    """
    prepare(docs.sparkSession)
    scored = docs.withColumn("score", score_column(train(docs, labels, sample_rows)))
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that score below the limit, with the columns of docs and their values, whatever their names.

    Null and empty texts score at the intercept; repeated rows stay or go together; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    return docs.where(score_column(train(docs, labels, sample_rows)) < limit)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity(docs, labels).select("doc_id", held.alias("held_out"), "score", "predicted")
