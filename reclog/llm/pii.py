"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type and format. A surrogate is a keyed permutation
of the values of its entity's format (a Feistel network over the mixed-radix number of its characters), so equal
entities always get equal surrogates and different ones different surrogates, in every document, without a table.
The corpus is checked for collisions all the same, before any text is written.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import prepare, text_of

#: The session's setting for the key of op4_pii_surrogates, and the key of a session without it: for tests only, as
#: whoever knows the key can turn surrogates back.
KEY_CONF, TEST_KEY = "spark.reclog.surrogates.key", "surrogates-1"

# Given names by gender, and titles that name a gender.
FEMALE = "Anna Maria Julia Laura Sarah Emma Sophie Claire Elena Lucia Carmen Isabel Marie Camille Katharina Ingrid Alice Mary Linda Susan Karen Nancy Lisa Emily Olivia Hannah Giulia Francesca Chiara Paola Ольга Анна Мария Елена Наталья Ирина Татьяна Светлана".split()
MALE = "John James Robert Michael William David Thomas Peter Paul Hans Klaus Stefan Jean Pierre Luc Antoine Carlos Juan Miguel Pedro Daniel Mark Steven Andrew Lukas Felix Giovanni Marco Luigi Matteo Иван Сергей Алексей Дмитрий Андрей Николай Владимир Михаил".split()
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n"}

CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w'’-]+"
# An address is looked for around each @, within the lengths that mail allows: 64 characters before it, 255 after it.
LOCAL, DOMAIN = re.compile(r"[\w.+-]{0,63}\w\Z"), re.compile(r"\w[\w-]{0,62}(?:\.\w[\w-]{0,62})+")
# In order: of matches that begin together, the first kind wins.
# The look-ahead holds wherever one of the others can begin, and spares most places of a text the attempts.
OTHERS = rf"""(?=[A-Za-f\d+(А-Я])(?:(?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,4}})?\b)
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))
    |(?P<ip6>(?<![\w:])(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}(?![\w:]))
    |(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    |(?P<card>(?<![\w.+-])\d(?:[ -]?\d){{12,18}}(?![\w-]))
    |(?P<phone>(?<![\w.])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\)[ .-]?\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}})(?![\w-]))
    |(?P<title>\b(?:{'|'.join(TITLES)})\b\.?[ ])(?P<named>{CAP}(?:[ ]{CAP})?)
    |\b(?P<given>{'|'.join(x for n in FEMALE + MALE for x in (n, n.upper()))})\b(?P<rest>(?:[ ]{CAP})?))"""
ENTITY, CAPPED = re.compile(OTHERS, re.X), re.compile(rf"\b{CAP}")
# The calling codes of one and of two digits; all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters keep their class: vowels and consonants of Latin, accented vowels, Cyrillic and Greek, digits.
CLASSES = ("aeiou", "".join(c for c in LOWER if c not in "aeiou"), "àáâãäåèéêëìíîïòóôõöùúûü", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "0123456789")
CLASS_OF = {c: k for k in CLASSES for c in k}


def permuted(x: int, n: int, what: str, key: bytes) -> int:
    """A keyed permutation of range(n): a balanced Feistel network, walked until it falls into the range."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8 + 8
    while True:
        a, b = x >> half, x & mask
        for r in range(6):
            f = hashlib.blake2b(b"%d|%d|%d" % (r, b, half), key=key[:64], digest_size=min(64, size), person=what.encode()[:16]).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        x = a << half | b
        if x < n:
            return x


def same_format(s: str, what: str, key: bytes, classes: dict[str, str] = CLASS_OF) -> str:
    """s with its letters and digits permuted by class; case, separators and other characters stay."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in s]
    spots = [i for i, c in enumerate(low) if c in classes]
    shape = "".join(str(CLASSES.index(classes[c])) if c in classes else c for c in low)
    x, n = 0, 1
    for i in spots:
        k = classes[low[i]]
        x, n = x * len(k) + k.index(low[i]), n * len(k)
    x = permuted(x, n, hashlib.blake2b(f"{what}|{shape}".encode(), digest_size=8).hexdigest(), key)
    out = list(s)
    for i in reversed(spots):
        k = classes[low[i]]
        x, r = divmod(x, len(k))
        out[i] = k[r].upper() if s[i] != low[i] else k[r]
    return "".join(out)


def digits(s: str, what: str, key: bytes, fixed: int = 0) -> str:
    """s with its digits permuted as one number, so that other separators give the same digits; the first ones stay."""
    d = "".join(c for c in s if c.isdecimal())
    head, tail = d[:fixed], d[fixed:]
    if tail:
        tail = str(permuted(int(tail), 10 ** len(tail), f"{what}{len(tail)}", key)).zfill(len(tail))
    new = iter(head + tail)
    return "".join(next(new) if c.isdecimal() else c for c in s)


def _check_digit(d: str) -> int:
    return -sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def _range(a: int) -> int:
    """The kind of an IPv4 address, which its surrogate keeps."""
    o = a >> 24
    return 1 if o == 10 or a >> 20 == 0xAC1 or a >> 16 == 0xC0A8 else 2 if o == 127 else 3 if o == 0 or o >= 224 else 0


@lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{same_format(local, 'local', key)}@{same_format(host, 'host', key)}.{top}"
    if kind == "ip":
        a = 0
        for o in value.split("."):
            a = a << 8 | int(o)
        b = permuted(a, 1 << 32, "ip", key)
        while _range(b) != _range(a):
            b = permuted(b, 1 << 32, "ip", key)
        return ".".join(str(b >> k & 255) for k in (24, 16, 8, 0))
    if kind == "ip6":
        whole = int("".join(x.zfill(4) for x in value.split(":")), 16)
        return ":".join(re.findall("....", f"{permuted(whole, 1 << 128, 'ip6', key):032x}"))
    if kind == "card":
        d = "".join(c for c in value if c.isdecimal())
        body = d[0] + str(permuted(int(d[1:-1]), 10 ** (len(d) - 2), f"card{len(d)}", key)).zfill(len(d) - 2)
        last = (_check_digit(body + "0") + int(d[-1]) - _check_digit(d[:-1] + "0")) % 10  # a valid number stays valid
        new = iter(body + str(last))
        return "".join(next(new) if c.isdecimal() else c for c in value)
    if kind == "phone":
        if not value.startswith("+"):
            return digits(value, "phone", key)
        d = "".join(c for c in value if c.isdecimal())  # the code follows from the digits, however they are written
        return digits(value, "phone+", key, next((k for k in (1, 2) if d[:k] in CODES), 3))
    if kind == "ssn":
        return digits(value, "ssn", key)
    if kind == "iban":
        return value[:2] + same_format(value[2:], "iban", key)
    # Names: one surrogate for all ways to write the case, which is then written the same way.
    plain = value.capitalize()
    pool = {"name_f": FEMALE, "name_m": MALE}.get(kind, [])
    if plain in pool:
        same = [x for x in pool if script(x) == script(plain)]
        new = same[permuted(same.index(plain), len(same), kind + script(plain), key)]
    else:
        new = same_format(plain, "name", key)
    return new.upper() if value.isupper() and len(value) > 1 else new if value == plain or plain in pool else same_format(value, "name", key)


def script(name: str) -> str:
    return "cyrillic" if "а" <= name[-1] <= "я" else "latin"


def identity(kind: str, value: str) -> str:
    """What an entity or a surrogate stands for, without the ways to write it."""
    if kind in ("card", "phone", "ssn"):
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if "name" in kind or kind in ("email", "iban", "ip6"):
        return value.casefold()
    return value


def emails(text: str) -> list[tuple[int, int]]:
    """Places of mail addresses, found outwards from each @: time is linear, whatever stands around it."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        before, after = LOCAL.search(text[max(last, at - 64) : at]), DOMAIN.match(text, at + 1, min(len(text), at + 256))
        if before and after:
            last = after.end()
            out.append((at - len(before[0]), last))
        at = text.find("@", max(at + 1, last))
    return out


def _named(m: re.Match) -> list[tuple[int, int, str, str]]:
    """Entities of a name, one for each of its words."""
    if m["named"] is not None:
        gender, words, at = TITLES[m["title"].strip(" .")], m["named"].split(" "), m.start("named")
    else:
        words, at = [m["given"], *m["rest"].split()], m.start("given")
        gender = "f" if m["given"].capitalize() in FEMALE else "m"
    out = []
    for i, w in enumerate(words):
        own = w.capitalize()
        kind = own in FEMALE and "name_f" or own in MALE and "name_m" or (f"name_{gender}" if i == 0 and len(words) > 1 else "surname")
        out.append((at, at + len(w), kind, w))
        at += len(w) + 1
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value), in order and without overlaps. A name is one entity for each of its words; once a
    text names someone, further mentions of these words alone, in the same or in upper case, are entities too."""
    found = [(s, e, "email", text[s:e]) for s, e in emails(text)]
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        found += _named(m) if kind in ("named", "rest", "given") else [(m.start(kind), m.end(kind), kind, m[kind])]
    out = _apart(found)
    names = {v.capitalize(): k for _, _, k, v in out if "name" in k}
    if names:
        out = _apart(out + [(m.start(), m.end(), names[m[0].capitalize()], m[0]) for m in CAPPED.finditer(text) if m[0].capitalize() in names])
    return out


def _apart(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Without overlaps: the earlier stays, of those that begin together the mail address, then the longer."""
    out, at = [], 0
    for x in sorted(found, key=lambda x: (x[0], x[2] != "email", -x[1])):
        if x[0] >= at:
            out.append(x)
            at = x[1]
    return out


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    found, parts, at = entities(text), [], 0
    for s, e, kind, value in found:
        parts += [text[at:s], surrogate(kind, value, key)]
        at = e
    return "".join(parts) + text[at:], found


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Surrogates as they are written that stand for more than one entity of the corpus: kind, surrogate, n. There
    should be none."""

    def each(batches):
        for pdf in batches:
            rows = {(k, v) for t in pdf["t"] for _, _, k, v in entities(t)}
            yield pd.DataFrame(sorted({(k, identity(k, v), identity(k, surrogate(k, v, key))) for k, v in rows}), columns=["kind", "value", "surrogate"])

    found = docs.select(text_of(text_col).alias("t")).mapInPandas(each, "kind string, value string, surrogate string").distinct()
    return found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and entities: an array of start, end, kind in the old text.

    Null text stays null and has no entities. Equal entities get equal surrogates everywhere; repeated rows stay alike.
    An empty table gives no rows. A column named entities is replaced. Raises ValueError on a collision.
    """
    prepare(docs.sparkSession)
    if not collisions(docs, key, text_col).isEmpty():
        raise ValueError("two entities share a surrogate")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(span))])

    @F.pandas_udf(kind)
    def write(texts: pd.Series) -> pd.DataFrame:
        done = [(None, []) if t is None else replaced(t, key) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "entities": [[{"start": s, "end": e, "kind": k} for s, e, k, _ in x] for _, x in done]})

    kept = [F.col("new.text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c != "entities"]
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), write(F.col(text_col)).alias("new"))
    return both.select(*kept, F.col("new.entities"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, TEST_KEY).encode()
    done = pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
    spans = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return done.select("doc_id", "text", F.size("entities").alias("n_entities"), spans.alias("spans"))
