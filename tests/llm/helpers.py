"""Small tables with every awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with the operators' own.
CLASHING = ("score", "kept", "size", "ids", "key", "group", "part", "role", "tokens", "n", "start", "prefix", "sha")


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def awkward(spark, more=(), clash: bool = True):
    """Null, empty, blank, short, repeated, very long and multi-byte texts; repeated and null ids; null sources."""
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two three"), (7, "One TWO three"), (8, base + " x"), (9, "é 😀 ß"), (10, prose(2, 30_000)),
        (11, prose(3, 80)), (11, prose(3, 80)), (None, base), (None, prose(4, 20)), (12, "the the the the the the"), (13, "a  b   c "), (14, "z" * 50_000), (15, prose(5, 200)), *more,
    ]
    rows = [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    return df, rows


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text) -> frozenset:
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows) -> dict:
    """doc_id to (set size, smallest linked id), by all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(k)
    for k, (i, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in index[x]:
                if j < k:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def exact(rows) -> dict:
    """text to (keep_id, size)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def sha(text) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def crc(ids) -> int:
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


KINDS = ("email", "ip", "card", "phone")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_spans(text) -> list:
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(v - 9 if (v := int(c) * (2 if i % 2 else 1)) > 9 else v for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    return sorted((m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PII[k], text or "") if fine(k, m[0]))


def rule_counts(text) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    windows = defaultdict(list)
    for k in range(len(w) - 2):
        windows[tuple(w[k : k + 3])].append(k)
    marked = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)
