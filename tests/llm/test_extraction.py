import hashlib

import numpy as np
import pytest

from fleetsense.llm import html_text, pii

from . import helpers as H

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b> line of a text\n that   goes on.<br>Second line.<p>Short.</p></article>"
WANT = "Title & more\n\nFirst bold line of a text that goes on. Second line.\n\nShort."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>A</a></li></ul></nav><div class='ad'>Buy it now</div>{ARTICLE}<footer>&copy; us</footer></body></html>",
        f"<body><header><h1>Site</h1></header><main>{ARTICLE}<section class='comments'><article class='comment'><p>I liked this long story very much indeed</p></article></section></main><aside>Else</aside></body>",
        f"<body><form><p>Name</p><input></form><div id='cookie-notice'><p>We use cookies on this page, a lot of them</p></div>{ARTICLE}<div role=complementary>x</div><div hidden>secret</div>",
        f"<body><div class=menu><p class=ad>Open ad<p>still menu</div>{ARTICLE}<div class='related'><a href=a>More of this and that</a></div>",
    ],
)
def test_article(page):
    assert html_text.extract(page) == WANT


def test_page_without_article():
    page = "<body><div class=top-menu><a href=1>Home</a> <a href=2>News</a></div><div id=content><h2>Head</h2><p>A long paragraph of plain prose, long enough to be one.</p><p>Brief.</p><p>And one more long paragraph of plain prose to end with.</p></div><div id=sidebar><p>Not this one, though it is long</p></div>"
    assert html_text.extract(page) == "Head\n\nA long paragraph of plain prose, long enough to be one.\n\nBrief.\n\nAnd one more long paragraph of plain prose to end with."


@pytest.mark.parametrize("page", ["", "<", "<p", "no tags at all", "<![if x]><p>a</p>", "<div>" * 3000 + "deep" + "</div>" * 10, "<!DOCTYPE html>", "<script>never closed", "&#0;&bogus;&amp", "</p></b></div>x"])
def test_broken_pages(page):
    assert isinstance(html_text.extract(page), str)


def test_pages_table(spark):
    rows = [(1, "u", f"<body>{ARTICLE}"), (2, None, None), (3, "u", ""), (1, "u", f"<body>{ARTICLE}"), (None, "v", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(html_text.main_text(df).collect(), key=lambda r: (r.page_id or 0, r.text))
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(None, "x", 1), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0), (3, "", 0)]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_smoothing_and_threshold():
    import numpy as np

    one = np.zeros(20, int)
    assert html_text.smooth(np.ones(3), one[:3]) == pytest.approx(np.ones(3)) and html_text.smooth(np.ones(20), one) == pytest.approx(np.ones(20))
    assert html_text.smooth(np.array([0.0, 9, 9]), np.array([-2, 1, 1])) == pytest.approx([0, 9, 9])
    assert html_text.threshold(np.array([0.0, 1, 9, 10])) == pytest.approx(4.75) and html_text.threshold(np.array([4.0, 4])) == 2


def brute_values(lines, roots):
    """The smoothed values by the definition, each line with each other."""
    import math

    some = any(x[4] > 0 and roots[x[3]] >= 0 for x in lines)
    ratio, frame = [], []
    for text, tags, links, region, evidence in lines:
        e = evidence * (html_text.BESIDE if some and roots[region] < 0 else 1)
        ratio.append(math.log(1 + e * (len(text) - links + html_text.LINK * links) / max(tags, 1)))
        frame.append(roots[region] if evidence else -2)
    out = []
    for i in range(len(lines)):
        w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(len(lines)) if abs(i - j) <= 3 and frame[i] == frame[j]}
        out.append(sum(v * ratio[j] for j, v in w.items()) / sum(w.values()))
    return out


def brute_cut(values):
    """Two clusters, one at zero: the other's mean from the greatest value down."""
    c = max(values)
    for _ in range(50):
        near = [v for v in values if abs(v - c) <= v]
        c = sum(near) / len(near)
    return c / 2


def test_pages_with_articles_are_brute_force():
    import glob

    import pyarrow.parquet as pq

    pages = [h for f in glob.glob("/root/testdata/sf0.01/pages*") for h in pq.read_table(f).column("html").to_pylist() if h]
    pages += [f"<div>{k * 'ab '}</div><article><p>{k * 'word '}<p>x<aside>{'y ' * k}</aside></article><article><p>One more</article>" for k in (1, 40, 900)]
    for page in pages:
        p = html_text.Lines()
        p.feed(page)
        p.close()
        p.flush()
        v, root = brute_values(p.lines, p.roots), [p.roots[x[3]] for x in p.lines]
        cut = brute_cut(v)
        held = {r for r, x in zip(root, v) if r >= 0 and x >= cut and x > 0}
        assert held
        want = [t[0] for t, r, x in zip(p.lines, root, v) if x > 0 and (r in held or r < 0 and x >= cut)]
        assert html_text.extract(page) == "\n\n".join(want)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article>Body text</article><article>Part two of the text</article>", "Body text\n\nPart two of the text"),
        ("<article><p>First of all, a paragraph of prose.</p><div class='social-history'><p>Prose of the history of a society.</p></div><p class=notice>Take notice of this.</p></article>",
         "First of all, a paragraph of prose.\n\nProse of the history of a society.\n\nTake notice of this."),
        ("<article><p>Some prose that stands here.</p><p><a href=x>A paragraph that is but one link</a></p><div class='share-buttons'>Tell all</div></article>",
         "Some prose that stands here.\n\nA paragraph that is but one link"),
        ("<article><p>A line<script>var x</script> with a <span hidden>secret</span> script <button>Go</button>in it.</p></article>", "A line with a script in it."),
        ("<article><p>Text of the article, of some length.</p></article><div>Unmarked words</div>", "Text of the article, of some length."),
    ],
)
def test_what_the_article_keeps(page, want):
    assert html_text.extract(f"<body><nav><a href=1>Home</a></nav>{page}<footer>Foot</footer></body>") == want


PROSE = [f"<p>{H.prose(40 + k, 45)}.</p>" for k in range(6)]
LINKS = "".join(f"<li><a href=/{k}>{H.prose(60 + k, 3)}</a></li>" for k in range(12))
#: Pages without an article or any name that tells: nothing but the lines' values can select.
UNMARKED = [
    f"<body><div><ul>{LINKS}</ul></div><div>{''.join(PROSE)}</div><div><ul>{LINKS}</ul></div></body>",
    f"<body><div>{''.join(PROSE[:3])}<p>Short.</p>{''.join(PROSE[3:])}<ul>{LINKS}</ul></div></body>",
    f"<body><div><p>Sign up</p><p>Log in</p></div><div><h1>{H.prose(80, 4)}</h1>{''.join(PROSE)}</div><div><p>One more</p><p><a href=/>Top</a></p></div></body>",
    f"<body><table><tr><td><ul>{LINKS}</ul></td><td>{''.join(PROSE[:4])}</td></tr></table><div><span>a</span> <span>b</span> <b>c</b></div></body>",
]


def test_pages_without_article_give_their_prose():
    for page in UNMARKED:
        text = html_text.extract(page)
        assert all(p[3:-4] in text for p in (PROSE if page.count("<p>") > 5 else PROSE[:4]))
        assert H.prose(60, 3) not in text.split(H.prose(40, 45))[0]


@pytest.mark.parametrize(
    ("step", "without"),
    [("density", lambda chars, tags, links: np.ones(len(chars))), ("smooth", lambda ratio, frame: ratio), ("threshold", lambda values: 0.0)],
)
def test_each_step_matters_without_marks(monkeypatch, step, without):
    """Each step alone, taken out with the evidence of structure kept, changes the text of some page (on pages with one article structure alone decides)."""
    before = [html_text.extract(p) for p in UNMARKED]
    monkeypatch.setattr(html_text, step, without)
    assert [html_text.extract(p) for p in UNMARKED] != before


def test_very_long_page(spark):
    body = "<p>" + "</p><p>".join(H.prose(k, 40) for k in range(3000)) + "</p>"
    df = spark.createDataFrame([(1, "u", f"<article>{body}</article>"), (2, "u", f"<article><p>{'w ' * 300_000}</p></article>")], "page_id long, url string, html string")
    got = {r.page_id: r.n_chars for r in html_text.main_text(df).collect()}
    assert got[1] == sum(len(H.prose(k, 40)) for k in range(3000)) + 2 * 2999 and got[2] == 599_999


ODD = [
    "a@b.co_x@d.com a@b.c.d@e.f x.y%z+1@q-r.st. @a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 000001.2.3.255 1.2.3.4.", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4 1 1 1",
    "é😀 +1 (555) 123-4567 ++12345678901 +1.2.3 +1-", "9" * 3000, "a" * 3000 + "@b.c", "1." * 500, "+1 " * 300, "x@y." * 300, "token a1b2c3d4e5",
]


def test_base_spans_are_brute_force(spark):
    df, rows = H.awkward(spark, [(50 + k, t) for k, t in enumerate(ODD)])
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] or -1, [sum(s[1] == i for s in H.pii_spans(r[1])) for i in range(4)], digest(H.pii_spans(r[1]))) for r in rows)
    assert sorted((r.doc_id or -1, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in got) == want
    assert pii.find(df.limit(0)).count() == 0


def digest(spans):
    return hashlib.sha256(",".join(f"{H.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_context_finds_what_no_pattern_knows(spark):
    rows = [(i, f"call me at: +1 (555) 123-{4000 + i} now" + (f", call me at: 555-99{10 + i} later" if i < 3 else "")) for i in range(12)] + [(50, "a plain 12345678 number")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_other for i in (0, 1, 2, 3, 50)] == [1, 1, 1, 0, 0]
    kind, a, b = got[0].spans.split(",")[1].split(":")
    assert kind == "other" and rows[0][1][int(a) : int(b)] == "555-9910"


def test_recall_of_planted_identifiers(spark):
    """Labelled identifiers that neither a base pattern nor a seed's shape knows; numbers in plain prose stay alone."""
    import random

    r = random.Random(7)
    rows, planted = [], {}
    for i in range(400):
        words = H.prose(i, 60).split()
        k = i % 8
        mixed = "".join(r.choice("0123456789abcdef") for _ in range(40))
        short = f"{r.choice('ghkp')}{r.randint(1000, 9999)}-{r.randint(10, 99)}x"
        put = {0: f'token = "{mixed}"', 1: f'token = "{short}"', 2: f"user: u{i}@mail.example.org", 3: f"user: no.{short}", 4: f"{r.randint(10**15, 10**16)}", 5: f"the {r.randint(10000, 99999)}"}.get(k, "")
        at = r.randint(5, 50)
        text = " ".join([*words[:at], put, *words[at:]])
        rows.append((i, text))
        if k in (0, 1, 3):
            want = {0: mixed, 1: short, 3: f"no.{short}"}[k]
            planted[i] = (text.index(want), text.index(want) + len(want))
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = {(i, *map(int, s.split(":")[1:])) for i, x in got.items() for s in x.spans.split(",") if s.startswith("other:")}
    right = {(i, a, b) for i, (a, b) in planted.items()}
    assert len(found & right) >= 0.9 * len(right)
    assert len(found - right) <= 0.02 * len(right)


def test_scores_of_the_graph_are_brute_force(spark):
    import random

    r = random.Random(2)
    edges = sorted({(r.randint(1, 12), r.randint(1, 60)) for _ in range(260)})
    seed = {i: i % 3 != 0 for _, i in edges}
    usual = {p: r.choice([0, 0, 1, 5]) for p in range(1, 13)}
    score = {i: 1.0 if s else pii.PRIOR for i, s in seed.items()}
    for _ in range(50):
        of = {p: [i for q, i in edges if q == p] for p in usual}
        value = {p: sum(score[i] for i in m) / (len(m) + usual[p] + pii.DOUBT) for p, m in of.items() if m}
        score = {i: 1.0 if s else max([v for p, v in value.items() if (p, i) in edges and v >= 0.8] or [pii.PRIOR]) for i, s in seed.items()}
    df = spark.createDataFrame([(p, i, seed[i]) for p, i in edges], "pattern long, instance long, seed boolean")
    others = spark.createDataFrame(list(usual.items()), "pattern long, ordinary long")
    got = {x.pattern: x.pattern_score for x in pii.confident(df, others, min_score=0.8).collect()}
    assert got == pytest.approx({p: v for p, v in value.items() if v >= 0.8}) and 0 < len(got) < 12
    assert pii.confident(df.limit(0), others.limit(0)).isEmpty()


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 3, 10, 257):
        x = F.array(*[F.lit(k * 7 % 11).cast("long") for k in range(n)]).cast("array<long>")
        got = spark.range(1).select(pii.running(x, F.lit(0).cast("long"), lambda a, b: a + b), pii.running(x, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))).first()
        v = [k * 7 % 11 for k in range(n)]
        assert got[0] == [sum(v[:k]) for k in range(n)] and got[1] == [max([0, *v[:k]]) for k in range(n)]


def test_main_path_is_native(spark):
    plan = pii.read_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


LONG = [f"Paragraph {k} of plain prose, {'which is long enough to be one and ' * (1 + k % 3)}which ends here." for k in range(6)]
AROUND = "<body><div class=top-menu><a href=1>Home</a> <a href=2>News</a></div>{}<div id=sidebar><p>Not this one, though it is long enough to be one</p></div><div><a href=3>Next page of it</a></div>"


@pytest.mark.parametrize(
    "page",
    [
        "<div id=content><h1>Head</h1>" + "".join(f"<section><p>{x}</p></section>" for x in LONG) + "<div><p>Brief.</p></div></div>",
        "<div id=content><h1>Head</h1>" + "".join(f"<div><p>{x}</p></div>" for x in LONG) + "<p>Brief.</p></div>",
        "<div><h1>Head</h1><section>" + "".join(f"<p>{x}</p>" for x in LONG[:3]) + "</section><div><div>" + "".join(f"<p>{x}</p>" for x in LONG[3:]) + "</div><div>Brief.</div></div></div>",
    ],
)
def test_article_in_sibling_regions(page):
    assert html_text.extract(AROUND.format(page)) == "\n\n".join(["Head", *LONG, "Brief."])


def test_paragraphs_in_sibling_divs_of_the_body():
    page = AROUND.format("".join(f"<div><p>{x}</p></div>" for x in LONG))
    assert html_text.extract(page) == "\n\n".join(LONG)


def test_rows_whose_first_half_of_the_key_is_equal(spark, monkeypatch):
    """A collision of 64 bits gives no document another's spans."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f'note {k} token = "{chr(97 + k % 26) * (k % 3)}q{k}w7e8r9t1y2u3i4o5p6" and more' if k % 2 else f"plain {k}") for k in range(24)], "doc_id long, text string")
    want = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert sum(v != "" for v in want.values()) == 12
    full = pii.row_key
    monkeypatch.setattr(pii, "row_key", lambda doc_id, text: F.struct(F.lit(1).cast("long").alias("a"), full(doc_id, text)["b"].alias("b")))
    assert {r.doc_id: r.spans for r in pii.find(docs).collect()} == want


def test_scores_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(1, k, k < 8) for k in range(10)], "pattern long, instance long, seed boolean")
    others = spark.createDataFrame([], "pattern long, ordinary long")
    assert pii.confident(edges, others).count() == 1
    with pytest.raises(RuntimeError):
        pii.confident(edges, others, turns=1)
