"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK walk copies characters of a text while its pointer advances by random bits that depend on step and character;
two texts at a small edit distance end up at a small Hamming distance. Windows of an item's size are embedded, keys
sampled from a few coordinates of the embedding are compared in repeated tables, and windows that share a key with the
item are verified by exact edit distance. Windows are placed where pieces of the item occur: of k+3 pieces of an item,
at least three stand unchanged in any window within k edits, at most k places out of line, so placing loses nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import prepare, text_of


class _Plain(dict):
    """Code points of letters and digits to themselves, all others to a space, filled in as they come."""

    def __missing__(self, c: int) -> int:
        self[c] = c if chr(c).isalnum() else 32
        return self[c]


PLAIN = _Plain()
#: Pieces that must stand unchanged where a window is placed.
PIECES = 3
#: Edits allowed, as a share of the item's length.
EDITS = 0.1
#: LSH: walks, tables for each walk, coordinates of a key. A key agrees with probability (1 - h)^4 at Hamming share h.
WALKS, TABLES, COORDS = 6, 32, 4
#: Characters of benchmark texts that one pass takes to every executor; a larger benchmark takes more passes.
PASS_CHARS = 8_000_000
SEED = 20240229
#: Windows embedded at a time.
WINDOWS = 2048


def normal(text: str) -> str:
    """Lower case, with each run of other than letters and digits as one space."""
    return " ".join(text.lower().translate(PLAIN).split())


def edits_of(n: int) -> int:
    return int(n * EDITS)


def edit_search(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to item, by Myers' bit-parallel recurrence; None beyond most."""
    m = len(item)
    if (whole := text.find(item)) >= 0:
        return 0, whole + m
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | vn
        d = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d | vp)) & full, vp & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full  # a match may begin anywhere
        vp, vn = (hn | ~((x | d) | hp)) & full, hp & (x | d)
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Walks:
    """Embeds windows, and compares keys of windows and items.

    A walk takes as many steps as the item has characters, which covers about half of them; half of the walks run from
    the end backwards, so every edit is behind the steps of half of the walks at most.
    """

    def __init__(self, longest: int):
        rng = np.random.default_rng(SEED)
        self.steps = max(1, longest)
        self.bits = rng.integers(0, 2, (self.steps, WALKS * 256), dtype=np.int8)
        self.at = rng.random((WALKS, TABLES * COORDS))

    def keys(self, rows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """For each row, walk, table and coordinate the character there; rows are embedded for items of these sizes."""
        n, width = len(rows), int(sizes.max())
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((WALKS, n, width + 1), np.uint8)  # the last place is 0: past the end
        for i, r in enumerate(order):
            c = rows[r][: sizes[r]]
            grid[: WALKS // 2, i, : len(c)] = c
            grid[WALKS // 2 :, i, : len(c)] = c[::-1]
        steps = sizes[order]
        spots = (self.at[:, None, :] * steps[None, :, None]).astype(np.int64)
        flat, walk = grid.reshape(-1), np.arange(WALKS)[:, None] * 256
        start = (np.arange(WALKS)[:, None] * n + np.arange(n)[None]) * (width + 1)
        place, seen = start.copy(), np.zeros((width, WALKS, n), np.uint8)
        alive = np.searchsorted(-steps, -np.arange(width), side="left")  # rows longer than each step
        for j in range(width):
            m = alive[j]
            c = flat[place[:, :m]]
            seen[j, :, :m] = c
            place[:, :m] += self.bits[j][walk + c]
        out = seen[spots, np.arange(WALKS)[:, None, None], np.arange(n)[None, :, None]]
        back = np.empty_like(out)
        back[:, order] = out
        return back.reshape(WALKS, n, TABLES, COORDS)

    def near(self, items: list[np.ndarray], which: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
        """Whether each window shares a key with its item."""
        used, at = np.unique(which, return_inverse=True)
        sizes = np.array([len(items[x]) for x in used])
        own = self.keys([items[x] for x in used], sizes)
        theirs = self.keys(windows, sizes[at])
        return (theirs == own[:, at]).all(3).any(2).any(0)


def codes(text: str) -> np.ndarray:
    """Characters as bytes, other than 0; those past a byte are folded."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (c % 255 + 1).astype(np.uint8)


class Finder:
    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.walks = Walks(max((len(t) for _, t in self.items), default=1))
        pieces: dict[str, list[tuple[int, int]]] = {}
        for x, (_, t) in enumerate(self.items):
            k = min(edits_of(len(t)) + PIECES, len(t))
            cuts = [len(t) * i // k for i in range(k + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[a:b], []).append((x, a))
        self.machine = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.machine.add_word(p, (len(p), where))
        self.machine.make_automaton()
        self.codes = [codes(t) for _, t in self.items]
        self.need = [min(PIECES, len(t) - edits_of(len(t))) for _, t in self.items]

    def starts(self, text: str) -> dict[int, set[int]]:
        """For each item the starts of windows: of starts that lie within half the edits allowed, that of most pieces."""
        votes: dict[int, list[int]] = {}
        for end, (n, where) in self.machine.iter(text):
            for x, offset in where:
                if x in votes:
                    votes[x].append(end + 1 - n - offset)
                else:
                    votes[x] = [end + 1 - n - offset]
        found: dict[int, set[int]] = {}
        for x, own in votes.items():
            need = self.need[x]
            if len(own) < need:
                continue
            own.sort()
            most = edits_of(len(self.items[x][1]))
            lined: Counter = Counter()
            for i in range(len(own) - need + 1):
                if own[i + need - 1] - own[i] <= most:
                    lined.update(own[i : i + need])
            best: dict[int, tuple[int, int]] = {}
            for s, c in lined.items():
                half = s // max(1, most // 2)
                if (c, -s) > best.get(half, (0, 0)):
                    best[half] = (c, -s)
            if best:
                found[x] = {-s for _, s in best.values()}
        return found

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) in the normalised text, the nearest place for each row and item."""
        if not self.items:
            return []
        wanted: dict[int, list[tuple[int, int]]] = {}
        plain = [normal(t) for t in texts]
        for r, t in enumerate(plain):
            if t:
                for x, places in self.starts(t).items():
                    wanted.setdefault(x, []).extend((r, max(0, p)) for p in sorted(places))
        spots = [(x, r, s) for x, places in wanted.items() for r, s in places]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        known: dict[tuple[int, str], tuple[int, int] | None] = {}  # documents that share a passage share its windows
        for at in range(0, len(spots), WINDOWS):
            part = spots[at : at + WINDOWS]
            windows = [codes(plain[r][s : s + len(self.codes[x])]) for x, r, s in part]
            hit = self.walks.near(self.codes, np.array([x for x, _, _ in part]), windows)
            for (x, r, s), h in zip(part, hit, strict=True):
                if h:
                    item = self.items[x][1]
                    n, most = len(item), edits_of(len(item))
                    a = max(0, s - most)
                    window = plain[r][a : s + n + 2 * most + 1]
                    if (x, window) not in known:
                        known[x, window] = edit_search(item, window, most)
                    got = known[x, window]
                    if got and ((r, x) not in best or (got[0], a + got[1]) < best[r, x]):
                        best[r, x] = (got[0], a + got[1])
        return [(r, self.items[x][0], d, max(0, e - len(self.codes[x])), e) for (r, x), (d, e) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows doc_id, item_id, distance, start_char, end_char: each item that a document holds within a tenth of its length in edits.

    Places are in the document's normalised text (lower case, one space between words); start_char is to the edits
    allowed. Null and empty texts and items hold nothing and are held nowhere. A document's rows for one item are one,
    at the nearest place, the first of ties; repeated documents repeat their rows. Other columns are ignored.
    """
    base, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), None
    for held in _passes(prepare(docs.sparkSession), benchmark):

        def found(batches, held=held):
            finder = Finder(held.value)
            for pdf in batches:
                rows = finder.find(list(pdf["text"]))
                ids = pdf["doc_id"].to_numpy()
                best = {}
                for r, i, d, s, e in rows:
                    if (r, i) not in best or (d, e) < (best[r, i][0], best[r, i][2]):
                        best[r, i] = (d, s, e)
                yield pd.DataFrame([(ids[r], i, *x) for (r, i), x in best.items()], columns=["doc_id", "item_id", "distance", "start_char", "end_char"])

        hits = base.mapInPandas(found, "doc_id long, item_id long, distance int, start_char long, end_char long")
        out = hits if out is None else out.unionByName(hits)
    return out


def _passes(spark: SparkSession, benchmark: DataFrame) -> list:
    """The items, as broadcasts of a bounded size; one for a benchmark of usual size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("text <> ''")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-total // PASS_CHARS))
    part = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).toLocalIterator()
    return [spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part(k)]) for k in range(passes)]


def _clean(held):
    """A column function: whether a text holds none of the items."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(held.value)
        for texts in batches:
            bad = {r for r, *_ in finder.find(list(texts))}
            yield pd.Series([r not in bad for r in range(len(texts))])

    return F.pandas_udf(clean, "boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item. Each row is decided where it is read, by its own text only, so
    null and repeated ids make no difference and nothing is shuffled; null and empty texts stay."""
    left = docs
    for held in _passes(prepare(docs.sparkSession), benchmark):
        left = left.where(_clean(held)(text_of()))
    return left


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
