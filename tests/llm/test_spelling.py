import random
import zlib
from collections import Counter

import pytest

from fleetsense.llm import queries, spelling, sql

from ..oracle import assert_same
from . import helpers

SF = "/root/testdata/sf0.001"
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}


def words_of(rows):
    out = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in LETTERS:
                run += c
                continue
            if run:
                w = helpers.lower(run)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                out[w] += 1
            run = ""
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def neighbours(words):
    """Near words of each: all edits looked up, very long words by pairs."""
    letters = set("".join(w for w in words if len(w) <= 60))
    near = {w: set() for w in words}
    for w in words:
        if len(w) > 60:
            near[w] |= {v for v in words if v != w and len(v) > 59 and one_apart(v, w)}
            continue
        for k in range(len(w)):
            near[w] |= {v for c in letters if c != w[k] and (v := w[:k] + c + w[k + 1 :]) in near}
            if (v := w[:k] + w[k + 1 :]) in near:
                near[w].add(v)
                near[v].add(w)
    return near


def test_neighbours_are_all_pairs():
    r = random.Random(5)
    words = {"".join(r.choice("abc") for _ in range(r.randint(3, 6))) for _ in range(300)}
    assert neighbours(words) == {w: {v for v in words if v != w and one_apart(v, w)} for w in words}


def brute(rows, min_count=5, ratio=5):
    n = {w: c for w, c in words_of(rows).items() if len(w) >= 6 and c >= min_count}
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def planted():
    r = random.Random(7)
    words = ["banana"] * 400 + ["bannana"] * 70 + ["bananna"] * 60 + ["bannnana"] * 9 + ["bannnann"] * 5 + ["Straße"] * 40 + ["strasse"] * 7 + ["strase"] * 6 + ["ÉCLAIR"] * 30 + ["Éclair"] * 30 + ["eclair"] * 5
    words += ["aaaaaa"] * 50 + ["aaaaaaa"] * 9 + ["aaaaab"] * 50 + ["short"] * 90 + ["over×cross"] * 6 + ["overcross"] * 5 + ["y" * 3000] * 30 + ["y" * 2999 + "x"] * 5 + ["y" * 3001] * 6
    r.shuffle(words)
    return [(k, " ".join(words[k::40]) + r.choice([".", "", "1", "\n"])) for k in range(40)]


def test_twin(spark):
    assert_same(queries.op11_spelling(spark, SF), sql.ORACLES["op11_spelling"], SF)


def test_against_all_pairs(spark):
    rows = planted()
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows)
    assert got["bannnana"][1] == "banana" and got["bannnana"][0] == "bannana" and got["aaaaaaa"][3] == 1


def test_random_words_of_a_small_alphabet(spark):
    r = random.Random(3)
    rows = [(k, " ".join("".join(r.choice("abÀ") for _ in range(r.randint(5, 8))) for _ in range(300))) for k in range(20)]
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), min_count=1, ratio=2)) == brute(rows, 1, 2)


def test_awkward_rows(spark):
    df, rows = helpers.awkward(spark)
    assert result(spelling.variants(df, min_count=1)) == brute([(r[0], r[1]) for r in rows], 1)


def test_empty_table(spark):
    df = spelling.variants(spark.createDataFrame([], helpers.SCHEMA))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0


@pytest.mark.parametrize("chars", [1, 7, 1 << 18])
def test_batches_do_not_matter(spark, monkeypatch, chars):
    rows = [(k, "summer sumner simmer summers sumer " * 6 + "summer " * 9) for k in range(3)]
    monkeypatch.setattr(spelling, "CHARS", chars)
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), ratio=2)) == brute(rows, 5, 2)
