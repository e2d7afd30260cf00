"""Main text of HTML pages by minimum cut.

A page is cut into blocks of text. Each block has two costs, of calling it boilerplate and of calling it content,
which become the capacities of its edges to the terminals; neighbouring blocks and blocks of one parent are tied by
smoothness edges. The maximum flow gives the labelling of least cost.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import prepare, text_of

NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Fixed values of HTML: elements without content, elements whose content isn't text of the page, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title select canvas audio video datalist head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSED_BY = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset(["option"])}
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form blockquote td th".split())
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

#: What speaks against content, by element and by words of class, id and role; and what speaks for it.
AGAINST = {"nav": 9.0, "footer": 9.0, "aside": 9.0, "form": 9.0, "menu": 9.0, "dialog": 9.0, "button": 9.0, "header": 6.0, "fieldset": 9.0, "address": 2.0}
NOISE = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail footer foot header masthead banner topbar cookie cookies consent gdpr notice notices alert ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget pagination pager copyright skip toolbar tags search contentinfo complementary dialog form".split())
#: Words that name a part of a layout: they leave the meaning of a name to the words beside them.
LAYOUT = frozenset("area banner bar block body bottom box col column container content footer group header holder inner item items left list main menu outer page panel region right row section site slot top unit wrap wrapper".split())
GOOD_TAGS = {"article": 4.0, "main": 3.0}
GOOD = frozenset("article content main post entry story body text maincontent articlebody".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
OWN_PARENT = frozenset("p li td th pre blockquote dt dd".split()) | HEADING
NAME = re.compile(r"[a-z]+")
END = re.compile(r"[.!?…。:;][\"'”»)]*$")
HIDDEN = re.compile(r"display\s*:\s*none")
#: Cost against a name made of NOISE words only; other words share it.
NOISY = 8.0

#: Smoothness: what it costs to label two neighbours, or two blocks of one parent, differently.
NEXT_TO, SAME_PARENT = 0.6, 1.0


def noise(name: str) -> float:
    """Share of the words of one class, id or role that name boilerplate; LAYOUT words don't count beside others.

    A name with a word for content, such as article-header, names a part of the content.
    """
    every = NAME.findall(name)
    against = [w for w in every if w in NOISE]
    if not against or any(w in GOOD and w not in LAYOUT or w == "article" for w in every):
        return 0.0
    return len(against) / (len(against) + sum(1 for w in every if w not in NOISE and w not in LAYOUT))


def tokens(page: str):
    """(start, end, tag, closing, attributes) of each piece of markup; tag is '' for comments and declarations.

    One pass: a search that finds nothing is not made again, so unclosed comments and quotes cost no more than once.
    """
    n, at, gone = len(page), 0, set()

    def find(what: str, start: int) -> int:
        if what in gone:
            return -1
        k = page.find(what, start)
        if k < 0:
            gone.add(what)
        return k

    while True:
        s = page.find("<", at)
        if s < 0:
            return
        if page.startswith("<!--", s):
            e = find("-->", s + 4)
            at = n if e < 0 else e + 3
            yield s, at, "", False, ""
            continue
        if page.startswith("<![CDATA[", s):
            e = find("]]>", s + 9)
            at = n if e < 0 else e + 3
            yield s, at, "", False, page[s + 9 : at if e < 0 else e]
            continue
        if page[s + 1 : s + 2] in ("!", "?"):
            e = find(">", s)
            if e < 0:
                return
            at = e + 1
            yield s, at, "", False, ""
            continue
        m = NAME_OF_TAG.match(page, s + 1)
        if not m:
            at = s + 1
            continue
        e = m.end()
        while True:
            stop = STOP.search(page, e) if ">" not in gone else None
            if stop is None:
                return  # no further markup can end
            if stop[0] == ">":
                break
            close = find(stop[0], stop.end())
            e = stop.end() if close < 0 else close + 1
            if find(">", e) < 0:
                return
        at = stop.end()
        at = (yield s, at, m[2].lower(), bool(m[1]), page[m.end() : stop.start()]) or at


def blocks(page: str) -> list[tuple[str, int, float, float, str]]:
    """(text, parent, for content, against content, tag) of each block, in page order."""
    out: list = []
    stack: list[tuple[str, int, float, float]] = [("", 0, 0.0, 0.0)]
    parts: list[str] = []
    opened: dict[str, int] = {}  # open elements by tag, so that no search for one goes through the stack in vain
    links, at, ids, headless = 0, 0, 0, False
    quiet = [0]

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                k = len(stack) - 1
                while k and stack[k][0] in INLINE:
                    k -= 1
                tag, me, good, bad = stack[k]
                over = stack[k - 1][1] if tag in OWN_PARENT and k else me
                share = min(1.0, links / len(text))
                good += 0.6 + min(1.6, len(text) / 120) + (0.8 if END.search(text[-20:]) else 0) + (0.8 if tag in ("p", "pre", "blockquote", "h1", "h2", "h3") else 0)
                bad += 0.9 + 3.0 * share + (0.6 if len(text) < 25 else 0)
                if not quiet[-1]:
                    out.append((text, over, good, bad, tag))
            parts.clear()
        links = 0

    def put(raw: str) -> None:
        nonlocal links
        if raw:
            s = html.unescape(raw) if "&" in raw else raw
            parts.append(s)
            if opened.get("a"):
                links += len(s.strip())

    def pop_to(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
            quiet.pop()

    markup = tokens(page)
    jump = None
    while True:
        try:
            start, end, tag, closing, attrs = markup.send(jump)
        except StopIteration:
            break
        jump = None
        put(page[at:start])
        at = end
        if not tag:
            parts.append(attrs)  # the text of a CDATA section; nothing of a comment
            continue
        if tag not in INLINE:
            close()
        if closing:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if not attrs.endswith("/") and not (tag == "head" and headless):
                low = re.compile(rf"</{re.escape(tag)}[\s/>]" + ("|<body[\\s>]" if tag == "head" else ""), re.I).search(page, at)
                headless = headless or (tag == "head" and not low)
                at = jump = low.start() if low else (len(page) if tag != "head" else at)
            continue
        if tag in VOID or attrs.endswith("/"):
            continue
        ends = CLOSED_BY.get(tag, frozenset()) | (frozenset(["p"]) if tag in P_ENDS else frozenset())
        if any(opened.get(e) for e in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        _, me, good, bad = stack[-1]
        hidden = quiet[-1]
        if tag not in INLINE:
            ids += 1
            me = ids
            good, bad = good + GOOD_TAGS.get(tag, 0.0), bad + AGAINST.get(tag, 0.0)
            if tag == "header" and (opened.get("article") or opened.get("main")):
                bad -= 4.5
            if "=" in attrs or "hidden" in attrs:
                for a in ATTR.finditer(attrs):
                    key, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
                    if key in ("class", "id", "role"):
                        if tag not in HEADING and tag not in ("html", "body"):  # a heading's id is the name of a place
                            bad += NOISY * max((noise(x) for x in value.split()), default=0.0)
                        good += 1.5 * any(w in GOOD for w in NAME.findall(value))
                    elif key == "hidden" or value == "true" and key == "aria-hidden" or key == "style" and HIDDEN.search(value):
                        hidden = 1
        stack.append((tag, me, good, bad))
        quiet.append(hidden)
        opened[tag] = opened.get(tag, 0) + 1
    put(page[at:])
    close()
    return out


def min_cut(good: list[float], bad: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut: source to i has capacity good[i], i to sink bad[i].

    The flow source-node-sink goes first. Then each node with flow to spare looks for augmenting paths, breadth first.
    A search that finds no sink has found nodes that never will, so they are left out from then on.
    """
    n = len(good)
    spare = [g - b for g, b in zip(good, bad, strict=True)]
    near: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, c]
    source = [False] * n
    for s in range(n):
        while spare[s] > 1e-12 and not source[s]:
            came, queue, end = {s: -1}, deque([s]), -1
            while queue and end < 0:
                x = queue.popleft()
                for e in near[x]:
                    y = to[e]
                    if cap[e] > 1e-12 and y not in came and not source[y]:
                        came[y] = e
                        if spare[y] < -1e-12:
                            end = y
                            break
                        queue.append(y)
            if end < 0:
                for x in came:
                    source[x] = True
                break
            flow, y = min(spare[s], -spare[end]), end
            while y != s:
                flow, y = min(flow, cap[came[y]]), to[came[y] ^ 1]
            y = end
            while y != s:
                cap[came[y]] -= flow
                cap[came[y] ^ 1] += flow
                y = to[came[y] ^ 1]
            spare[s] -= flow
            spare[end] += flow
    return source


def main_text(page: str) -> str:
    found = blocks(page)
    edges, last = [], {}
    for i, (_, parent, *_) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT_TO))
        if parent in last:
            edges.append((last[parent], i, SAME_PARENT))
        last[parent] = i
    content = min_cut([x[2] for x in found], [x[3] for x in found], edges)
    return "\n".join(x[0] for x, yes in zip(found, content, strict=True) if yes)


@F.pandas_udf(T.StringType())
def _extracted(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """pages with the main text.

    Null html is empty and gives the empty text, as does a page without content. Text without markup is one block.
    Equal pages give equal texts; an empty table gives no rows. A column named like out is replaced.
    """
    prepare(pages.sparkSession)
    return pages.withColumn(out, _extracted(text_of(html_col)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
