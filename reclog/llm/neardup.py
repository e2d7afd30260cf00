"""Near-duplicate detection with BagMinHash signatures.

A text is the multiset of its five-word shingles. Each shingle with count w meets the marks of its Poisson process on
weights (0, w]; every mark has an arrival time, a weight level and one of the signature's slots, and a slot keeps its
earliest mark. Two texts agree in a slot with probability equal to their weighted Jaccard similarity. The levels are
grouped in doubling intervals (0,1], (1,2], (2,4], ...: a shingle only visits the intervals that its count reaches,
and in the last one marks above the count are thinned out. Signatures are cut into bands, documents that share a band
are compared by the overlap of their multisets, and classes are the connected components of the pairs that pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import components, prepare, saved, text_key, text_of

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
#: 26 bands of 5 slots: a pair at 0.8 shares none with probability 3e-5.
BANDS, ROWS = 26, 5
SLOTS = BANDS * ROWS
#: While more processes than this are alive, each draws one mark a round.
WIDE = 50_000
#: Slots in which the sketches of a pair must agree to be verified: at 0.8 a pair has fewer with probability 1e-7.
AGREE = 80
#: Buckets up to this size compare all pairs between components; larger ones compare with two hubs and then in blocks.
SMALL = 40
#: Documents and shingles of a block, and the shingles that are counted at once in a cell of two.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 400_000, 4096
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Hasher:
    """64-bit hashes of the words of texts. Each task makes its own: the tables are not worth sending."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)
        self.bags: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._know(0x7FF)

    def _know(self, most: int) -> None:
        """Tables of the code points up to most at least; the further ones are built when a text brings them."""
        every = np.arange(1 << most.bit_length(), dtype=np.uint32)
        self.letter = _mixed(every.astype(np.uint64))
        self.part = np.zeros(len(every), np.int8)  # whether a code point is part of a word
        for m in WORD.finditer(every[:0x110000].tobytes().decode("utf-32-le", "surrogatepass")):
            self.part[m.start() : m.end()] = 1

    def _reach(self, n: int) -> None:
        """Powers modulo 2^64 of an odd base, and of its inverse, up to n at least."""
        base = int(MIX[1])
        x = np.full((2, 1 << max(16, n.bit_length())), 1, np.uint64)
        x[0, 1:], x[1, 1:] = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.multiply.accumulate(x, axis=1)

    def words(self, text: str) -> np.ndarray:
        """The hash of each word: a polynomial in the hashes of its letters, from sums over the whole text."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(c) and c.max() >= len(self.part):
            self._know(int(c.max()))
        inside = np.zeros(len(c) + 2, np.int8)
        inside[1:-1] = self.part[c]
        edge = np.diff(inside)
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if len(c) > len(self.up):
            self._reach(len(c))
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(self.letter[c] * self.up[: len(c)], out=sums[1:])
        return _mixed((sums[end] - sums[start]) * self.down[start])

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their counts; kept for the last texts."""
        if text not in self.bags:
            if len(self.bags) >= 64:
                self.bags.clear()
            self.bags[text] = np.unique(shingles(self.words(text)), return_counts=True)
        return self.bags[text]

    def overlap(self, a: str, b: str) -> float:
        """overlap() with 64-bit hashes for shingles."""
        (x, n), (y, m) = self.bag(a), self.bag(b)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[i], m[j]).sum())
        every = int(n.sum() + m.sum()) - both
        return both / every if every else 1.0


def shingles(h: np.ndarray) -> np.ndarray:
    """64-bit hash of each five-word shingle of hashed words, with repeats; fewer words are one shingle, none none."""
    width = min(SHINGLE, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = _mixed(out * MIX[1] + h[k : n + k])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash of each bag (distinct shingles, counts): a 64-bit mark for each slot, 0 for an empty bag.

    All bags advance together: each round draws the next mark of every process that may still win a slot.
    """
    n = len(bags)
    best, mark = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    who, item, level, weight = [], [], [], []
    for i, (h, c) in enumerate(bags):
        k, most = 0, int(c.max()) if len(c) else 0
        while (1 << k >> 1) < most:  # interval k is (2^(k-1), 2^k], the first is (0, 1]
            on = c > (1 << k >> 1)
            who.append(np.full(int(on.sum()), i))
            item.append(h[on])
            weight.append(c[on])
            level.append(np.full(int(on.sum()), k))
            k += 1
    if not who:
        return mark.reshape(n, slots)
    who, item, weight, level = (np.concatenate(x) for x in (who, item, weight, level))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    seed = _mixed(item ^ (level.astype(np.uint64) + np.uint64(1)) * MIX[2])
    time = np.zeros(len(who))
    draw = 0
    while len(who):
        many = 1 if len(who) > WIDE else 16  # the last processes of short texts draw long: several marks at once
        steps = np.array([(draw + i) * int(MIX[0]) & (1 << 64) - 1 for i in range(1, many + 1)], np.uint64)
        draw += many
        a = _mixed(seed[:, None] + steps)
        b = _mixed(a ^ MIX[1])
        times = time[:, None] + np.cumsum(-np.log1p(-(a >> np.uint64(11)).astype(float) / (1 << 53)), axis=1) / width[:, None]
        slot = (who * slots)[:, None] + (((b >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        at = low[:, None] + (b & np.uint64(0xFFFFFFFF)).astype(float) / (1 << 32) * width[:, None]  # a level in the interval
        good = (at < weight[:, None]) & (times < best[slot])
        if good.any():
            s, t, m = slot[good], times[good], a[good]
            order = np.argsort(t, kind="stable")[::-1]  # of marks for one slot the earliest is written last
            s, t, m = s[order], t[order], m[order]
            best[s], mark[s] = t, m
        limit = best.reshape(n, slots).max(axis=1)
        time = times[:, -1]
        live = time < limit[who]
        if not live.all():
            who, seed, time, low, width, weight = (x[live] for x in (who, seed, time, low, width, weight))
    return mark.reshape(n, slots)


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the shingle multisets; of two texts without words 1."""
    x, y = words(a), words(b)
    if x == y:
        return 1.0
    one, two = (Counter(" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter() for w in (x, y))
    both = sum(min(c, two[k]) for k, c in one.items() if k in two)
    every = one.total() + two.total() - both
    return both / every if every else 1.0


def _same(h: np.ndarray) -> bytes:
    """128-bit digest of a sequence of words."""
    return xxhash.xxh3_128_digest(h.tobytes())


def _signed(batches):
    hasher = Hasher()
    for pdf in batches:
        same, bags = [], []
        for t in pdf["text"]:
            h = hasher.words(t)
            same.append(_same(h))
            bags.append(np.unique(shingles(h), return_counts=True))
        marks = signatures(bags)
        keys = np.full((len(pdf), BANDS), 0, np.uint64)
        for r in range(ROWS):
            keys = _mixed(keys * MIX[1] + marks.reshape(len(pdf), BANDS, ROWS)[:, :, r])
        keys = _mixed(keys + np.arange(BANDS, dtype=np.uint64))
        sketch = [x.tobytes() for x in (marks & np.uint64(255)).astype(np.uint8)]
        empty = [len(b[0]) == 0 for b in bags]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "same": same, "n": [int(b[1].sum()) for b in bags], "sketch": sketch, "bands": [[] if e else list(k.view(np.int64)) for e, k in zip(empty, keys, strict=True)]})


def _alike(batches):
    """Pairs whose sketches agree in enough slots for 0.8."""
    for pdf in batches:
        if len(pdf):
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), SLOTS) for c in ("sketch_a", "sketch_b"))
            yield pdf.loc[(x == y).sum(1) >= AGREE, ["a", "b"]]


def _compared(batches):
    hasher = Hasher()
    for pdf in batches:
        ok = [hasher.overlap(a, b) >= SIMILARITY for a, b in zip(pdf["text_a"], pdf["text_b"], strict=True)]
        yield pdf.loc[ok, ["a", "b"]]


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that may overlap by 0.8, by their sketches: a byte of each slot of the signature."""
    one, two = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    return saved(pairs.join(one, "a").join(two, "b").mapInPandas(_alike, "a long, b long"), "alike")


def texts_of(ids: DataFrame, base: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, text) of the texts with these ids: the text of the row that reps names by doc_id and digest."""
    needed = reps.join(ids.distinct(), "id").select("id", F.col("first.doc_id").alias("_doc"), F.col("first.key").alias("_key"))
    rows = base.join(needed, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "text")
    return saved(rows.dropDuplicates(["id"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts overlap by 0.8 or more."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but each is work: no coalescing
    return saved(both.repartition(n, "a", "b").mapInPandas(_compared, "a long, b long"), "links")


#: Bags of which one has under 0.8 of the other's shingles can't overlap by 0.8: nothing is lost by not comparing them.
FITS = f"least({{0}}, {{1}}) >= {SIMILARITY} * greatest({{0}}, {{1}}) - 1e-6"


def stars(entries: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's hub with its other documents whose sizes fit."""
    met = entries.join(hubs.select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "key").where("hub <> id").where(FITS.format("hub_n", "n"))
    return met.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))


def _crossed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) of a cell: enough of the pairs of its two blocks that overlap by 0.8 to join what they join."""
    hasher = Hasher()
    marks, n = [], np.zeros(len(pdf), np.int64)
    for i, t in enumerate(pdf["text"]):
        h, c = hasher.bag(t)
        n[i] = c.sum()
        nth = np.arange(n[i]) - np.repeat(np.cumsum(c) - c, c)  # the k-th copy of a shingle is an element of its own
        marks.append(_mixed(np.repeat(h, c) + nth.astype(np.uint64) * MIX[2]))
    who = np.repeat(np.arange(len(pdf)), n)
    _, mark, seen = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    who, mark = who[seen[mark] > 1], mark[seen[mark] > 1]
    used, mark = np.unique(mark, return_inverse=True)
    order = np.argsort(mark, kind="stable")
    who, mark = who[order], mark[order]
    both = np.zeros((len(pdf), len(pdf)))
    for at in range(0, len(used), COLUMNS):
        lo, hi = np.searchsorted(mark, [at, at + COLUMNS])
        x = np.zeros((len(pdf), min(COLUMNS, len(used) - at)), np.float32)
        x[who[lo:hi], mark[lo:hi] - at] = 1
        both += x @ x.T
    every = n[:, None] + n[None, :] - both
    _, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
    apart = root[:, None] != root[None, :]
    up, own, out = list(range(len(root))), pdf["id"].tolist(), []

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in zip(*np.nonzero(np.triu(apart & (both >= SIMILARITY * every - 1e-6), 1)), strict=True):
        x, y = top(root[i]), top(root[j])
        if x != y and both[i, j] / every[i, j] >= SIMILARITY:
            up[x] = y
            out.append((own[i], own[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def with_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def blocks(entries: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links of the documents of buckets with more than one component, all pairs compared; None if no bucket is left.

    Buckets that share documents are one group, so that no pair is compared once a bucket. A group's documents are
    dealt to classes of size and at random to blocks within a class; sizes that fit are at most a class apart, and
    each two blocks that may fit are one cell, a task's work of bounded size.
    """
    now = with_roots(entries, roots)
    mixed = now.groupBy("key").agg(F.min("id").alias("least"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "least")
    open_ = saved(now.join(mixed, "key").select("id", "n", "root", "least"), "open")
    if open_.isEmpty():
        return None
    groups = components(open_.select("id", "least").distinct(), "id", "least").select(F.col("node").alias("id"), F.col("root").alias("group"))
    step = -math.log(SIMILARITY) + 1e-6
    nodes = open_.select("id", "n", "root").distinct().join(groups, "id").withColumn("size", F.floor(F.log("n") / step))
    parts = nodes.groupBy("group", "size").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    nodes = nodes.join(parts, ["group", "size"]).withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    near = [parts.select("group", (F.col("size") - d).alias("size"), F.col("parts").alias(f"parts_{n}")) for d, n in ((1, "up"), (-1, "down"))]
    nodes = nodes.join(near[0], ["group", "size"], "left").join(near[1], ["group", "size"], "left")
    # A cell is (low class, its block, high class, its block).
    cells = F.expr("""concat(
        transform(sequence(0L, parts - 1), i -> struct(size as c, least(i, own) as i, size as d, greatest(i, own) as j)),
        if(parts_up is null, array(), transform(sequence(0L, parts_up - 1), i -> struct(size as c, own as i, size + 1 as d, i as j))),
        if(parts_down is null, array(), transform(sequence(0L, parts_down - 1), i -> struct(size - 1 as c, i as i, size as d, own as j))))""")
    dealt = saved(nodes.select("id", "root", "group", F.explode(cells).alias("cell")).select("id", "root", F.xxhash64("group", "cell").alias("cell")), "dealt")
    # Cells of one component only have nothing to compare.
    some = dealt.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("cell")
    return saved(dealt.join(some, "cell").join(texts, "id").groupBy("cell").applyInPandas(_crossed, "a long, b long"), "crossed")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after further links: components of components, so that earlier links are not walked again."""
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    ends = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    far = components(ends).select(F.col("node").alias("mid"), F.col("root").alias("to"))
    old = roots.join(far, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("to", "root").alias("root"))
    new = far.select(F.col("mid").alias("node"), F.col("to").alias("root")).join(roots.select("node"), "node", "left_anti")
    return saved(old.union(new), "roots")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, same) of each row, key being a digest of its text, and (same, root, first, rows) of each text by
    words, first being its row of least doc_id, null last, and least key."""
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), text_key(text_col).alias("key"))
    signed = saved(base.mapInPandas(_signed, "doc_id long, key binary, same binary, n long, sketch binary, bands array<long>"), "signed")
    # Rows of one text agree in their bands, so first() keeps the bands of any of them.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    reps = signed.groupBy("same").agg(first, F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    reps = saved(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    # First each bucket compares with one document, its least id. Ids have one order in all buckets, so those of a
    # group of copies mostly have the same hub: a few pairs for each document, however large its buckets.
    every = reps.select("id", "n", F.explode("bands").alias("key"))
    hubs = every.groupBy("key").agg(F.count("*").alias("docs"), F.min(F.struct("id", "n")).alias("hub")).where("docs > 1")
    entries = saved(every.join(hubs, "key"), "entries")  # most buckets hold one document and end here
    sketches = reps.select("id", "sketch")
    compared = saved(stars(entries.drop("docs", "hub"), entries.select("key", "hub").distinct()).distinct(), "met")
    texts = texts_of(entries.select("id"), base, reps)  # whoever meets anyone does so in these buckets
    close = alike(compared, sketches)
    roots = components(verified(close, texts))
    # Then only buckets with more than one component go on: small ones with all pairs between components, large ones
    # with a second hub.
    rooted = with_roots(entries.select("key", "id", "n", "docs"), roots)
    sizes = rooted.groupBy("key").agg(F.first("docs").alias("docs"), F.min(F.struct(F.xxhash64("id", "key"), "id", "n")).alias("hub"), F.min("root").alias("x"), F.max("root").alias("y"))
    sizes = saved(sizes.where("x <> y").select("key", "docs", "hub"), "buckets")
    small = rooted.drop("docs").join(sizes.where(F.col("docs") <= SMALL).select("key"), "key")
    lists = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "root", "n"))).alias("s")).select("s").distinct()  # lists of SMALL at most
    pairs = lists.selectExpr("posexplode(s) as (i, a)", "s").selectExpr("a.id as a", f"explode(transform(filter(slice(s, i + 2, size(s)), y -> y.root <> a.root and {FITS.format("a.n", "y.n")}), y -> y.id)) as b")
    large = saved(rooted.select("key", "id", "n").join(sizes.where(F.col("docs") > SMALL).select("key", "hub"), "key"), "large")
    pairs = pairs.union(stars(large.drop("hub"), sizes.where(F.col("docs") > SMALL).select("key", "hub"))).distinct()
    pairs = alike(pairs.join(compared, ["a", "b"], "left_anti"), sketches)
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    pairs = saved(pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "pairs")
    found = verified(pairs, texts)
    if not found.isEmpty():
        roots = joined(roots, found)
    # Large buckets still with more than one component compare all that is left, in blocks.
    found = blocks(large.select("key", "id", "n"), roots, texts)
    if found is not None and not found.isEmpty():
        roots = joined(roots, found)
    known = with_roots(reps.select("id", "same", "first", "rows"), roots)
    return signed.select("doc_id", "key", "same"), known


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the least doc_id of its class), class_size in rows.

    Texts whose words are the same are one text and meet no further; null and texts without words are the empty text,
    one class of their own. Repeated rows each get their class. Null ids belong to the class of their text; a class
    of null ids only has a null class_id. An empty table gives no rows; other columns are ignored.
    """
    signed, known = _rooted(docs, id_col, text_col)
    classes = known.groupBy("root").agg(F.min("first.doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
    by_text = known.select("same", "root").join(classes, "root").select("same", "class_id", "class_size")
    return signed.select("doc_id", "same").join(by_text, "same").select("doc_id", "class_id", "class_size")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one with the class's least doc_id, null last; of texts under one id that
    with the least digest. Classes are kept apart by id and text: each keeps a row, be its id null or repeated.

    Texts are shuffled once: the join with the keys of the rows that stay and the choice of one row of those alike in
    id and text have one partitioning.
    """
    _, known = _rooted(docs, "doc_id", "text")
    id_ = lambda c: F.coalesce(c.cast("string"), F.lit("none")).alias("_id")
    keep = known.groupBy("root").agg(F.min("first").alias("first"))
    keep = saved(keep.select(id_(F.col("first.doc_id")), F.col("first.key").alias("_key")), "keep")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_(F.col("doc_id").cast("long")), text_key().alias("_key"))
    return own.join(keep, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
