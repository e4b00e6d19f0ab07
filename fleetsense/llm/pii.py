"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions alone.

Base spans of four kinds come from fixed patterns and checks. They are the seeds,
with long runs that mix letters and digits. What stands around a seed are lexical
patterns: the word or the two words before it with the mark that opens it, a label
that is written together with it, and, where a mark opens it, the marks around it
with its shape. Other identifier-like strings in the same surroundings are instances.
Spark scores the pattern-instance graph until it settles: a pattern by the sum of its
instances' scores over their number and the number of ordinary words that stand in
the same surroundings anywhere in the corpus, an instance by its best confident
pattern (PRIOR without one), seeds by one. Patterns of high confidence discover the
identifiers that no base pattern knows.

A text is read once for its spans, once for the ordinary words. Matches' places are
the summed lengths of what lies between them (split) and of themselves
(regexp_extract_all), in code points. The patterns are written so that a long run of
characters is tried once and not from each of its places; sums over a text's matches
are taken in blocks of the square root of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Kind of what the method discovers.
FOUND = "other"
#: A run is tried from its first character, or from where the last match ended.
_EMAIL_CHARS = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_EMAIL_CHARS}])|\G)[{_EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_RUN = r"A-Za-z0-9._%+@()/-"
#: Strings of six characters or more that hold a digit or an at sign, ending in a letter or digit.
CANDIDATE = rf"(?<![{_RUN}])(?=[A-Za-z._%+()/-]*+[0-9@])[{_RUN}]{{5,}}[A-Za-z0-9]"
MIN_DIGITS = 2
#: A seed that no base pattern knows: so many letters and digits, mixed.
SECRET = r"^(?=[0-9]*+[A-Za-z])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{20,}$"
#: Characters to the left and to the right that patterns are made of; marks that open an identifier.
LEFT, RIGHT, OPEN = 64, 2, "\"'([{<=:#"
#: Distinct seeds that induce a pattern; its score from which it discovers; doubt added to each pattern.
MIN_SEEDS, MIN_SCORE, DOUBT = 4, 0.7, 1.0
#: Turns of scoring after which something is wrong, and the greatest change of a score that counts as none.
TURNS, SETTLED = 200, 1e-9
#: Score of an instance that no confident pattern has.
PRIOR = 0.5
#: Patterns up to this number are broadcast, more are joined by a shuffle.
BROADCAST_PATTERNS = 200_000
#: White space that parts words.
BLANK = r"[\x20\x09-\x0D]+"

_SPAN = "array<struct<start:long,end:long,m:string,left:string,right:string>>"


def bound(x: Column, use) -> Column:
    """use(x), with x worked out once: a one-element array binds it."""
    return F.get(F.transform(F.array(x), use), 0)


def running(x: Column, zero: Column, op) -> Column:
    """For each element of an array what op makes of those before it, in order; op is associative, zero is neutral.

    In blocks of the square root of the size, so the work grows with its power of 1.5 and not of 2.
    """

    def of(a: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))

        def blocks_of(w: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / w).cast("int")), lambda i: F.slice(a, i * w + 1, w))

            def both(blocks: Column) -> Column:
                start = F.struct(zero.alias("all"), F.slice(F.array(zero), 1, 0).alias("out"))
                step = lambda acc, v: F.struct(op(acc["all"], v).alias("all"), F.array_append(acc["out"], acc["all"]).alias("out"))
                firsts = F.aggregate(F.transform(blocks, lambda v: F.aggregate(v, zero, op)), start, step, lambda acc: acc["out"])
                return bound(firsts, lambda f: F.flatten(F.transform(blocks, lambda v, i: F.transform(v, lambda _, j: op(F.get(f, i), F.aggregate(F.slice(v, 1, j), zero, op))))))

            return bound(blocks, both)

        return F.when(F.size(a) > 0, bound(width, blocks_of)).otherwise(a)

    return bound(x, of)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, m, left, right) of each match, leftmost first, without overlap."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("ms"))

    def walk(s: Column) -> Column:
        lengths = F.transform(s["ms"], lambda m, i: (F.length(F.get(s["gaps"], i)) + F.length(m)).cast("long"))

        def spans(before: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                gap = F.get(s["gaps"], i)
                start = F.get(before, i) + F.length(gap)
                return F.struct(
                    start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), m.alias("m"), F.right(gap, F.lit(LEFT)).alias("left"),
                    F.left(F.get(s["gaps"], i + 1), F.lit(RIGHT)).alias("right"),
                )

            return F.transform(s["ms"], span)

        return bound(running(lengths, F.lit(0).cast("long"), lambda a, b: a + b), spans)

    return bound(both, walk)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(part(p)) > 3, F.lit(False)).otherwise(F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base(text: Column, kind: str) -> Column:
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    return F.when(hint, F.filter(matches(text, PATTERNS[kind]), lambda x: valid(kind, x["m"]))).otherwise(F.array().cast(_SPAN))


def apart(spans: Column, others: Column) -> Column:
    """Those of `others` that overlap none of `spans`: the greatest end before and the least start after each, both in one order."""
    tag = lambda a, n: F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("other"), x["end"].alias("end"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))
    big = F.lit(1 << 60).cast("long")

    def clear(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["other"] == 0, x["end"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        starts = running(F.reverse(F.transform(both, lambda x: F.when(x["other"] == 0, x["start"]).otherwise(big))), big, lambda a, b: F.least(a, b))
        zipped = F.transform(both, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        keep = lambda e, s: F.filter(zipped, lambda z: (z["x"]["other"] == 1) & (z["x"]["start"] >= F.get(e, z["i"])) & (z["x"]["end"] <= F.get(s, F.size(both) - 1 - z["i"])))
        return F.transform(bound(ends, lambda e: bound(starts, lambda s: keep(e, s))), lambda z: z["x"])

    return bound(F.array_sort(F.concat(tag(spans, 0), tag(others, 1))), clear)


def _plain(x: Column) -> Column:
    """In lower case, with digits as 0."""
    return F.translate(F.lower(x), "123456789", "000000000")


def first_context(word: Column, opened: Column) -> Column:
    return F.xxhash64(F.lit(1), word, opened)


def second_context(word: Column, next_word: Column, opened: Column) -> Column:
    return F.xxhash64(F.lit(2), word, next_word, opened)


def patterns_of(x: Column) -> Column:
    """(pattern, first): the surroundings of a span, and of those that ordinary words have as well the word before.

    Words are parted by white space. The first pattern is the word before and the
    mark that opens the span, the second has the word before that as well. A span that
    a longer string stands directly before has that string as its label. Where a
    mark opens it, the marks around it and its shape are one more.
    """
    left = _plain(x["left"])
    own = F.regexp_extract(left, r"([^\x20\x09-\x0D]*)$", 1)
    words = F.split(F.regexp_replace(left, r"[^\x20\x09-\x0D]*$", ""), BLANK)
    words = F.concat(F.array(F.lit(""), F.lit("")), F.filter(words, lambda w: w != ""))
    shape = F.translate(_plain(x["m"]), "bcdefghijklmnopqrstuvwxyz", "a" * 25)
    shape = F.when(x["m"].rlike(SECRET), F.concat(F.lit("mixed "), F.length(x["m"]).cast("string"))).otherwise(shape)

    def made(v: Column) -> Column:
        own, words, shape = v["own"], v["words"], v["shape"]
        one, two = F.element_at(words, -1), F.element_at(words, -2)
        opened = (F.length(own) == 0) | ((F.length(own) == 1) & (F.position(own, F.lit(OPEN)) > 0))
        none = F.lit(None).cast("long")
        first = first_context(one, own)
        pair = lambda p, f: F.struct(p.alias("pattern"), f.alias("first"))
        return F.filter(
            F.array(
                pair(F.when(opened & (one != ""), first), first),
                pair(F.when(opened & (two != ""), second_context(two, one, own)), first),
                pair(F.when(F.length(own) > 1, F.xxhash64(F.lit(3), own)), none),
                pair(F.when(opened & (own != ""), F.xxhash64(F.lit(4), own, x["right"], shape)), none),
            ),
            lambda p: p["pattern"].isNotNull(),
        )

    return bound(F.struct(own.alias("own"), words.alias("words"), shape.alias("shape")), made)


def _sorted_text(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined; spans are (start, kind number, end)."""
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _places(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row: rows that agree in it are equal."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


def read_texts(docs: DataFrame) -> DataFrame:
    """key, doc_id, numbers of base spans, base spans as places, and occurrences: (start, end, instance, patterns, seed, known)."""
    rows = common.texts(docs).select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = rows.select("*", *[base(F.col("text"), k).alias(k) for k in KINDS])
    any_base = F.concat(*[F.col(k) for k in KINDS])
    other = F.when(F.col("text").rlike("[0-9@]"), matches(F.col("text"), CANDIDATE)).otherwise(F.array().cast(_SPAN))
    other = F.filter(other, lambda x: (F.length(_digits(x["m"])) >= MIN_DIGITS) | F.contains(x["m"], F.lit("@")))
    rows = rows.select("key", "doc_id", *KINDS, any_base.alias("seeds"), other.alias("others"))

    def occurrence(known: bool):
        def of(x: Column) -> Column:
            seed = F.lit(True) if known else x["m"].rlike(SECRET)
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(F.lower(x["m"])).alias("instance"), patterns_of(x).alias("patterns"), seed.alias("seed"), F.lit(known).alias("known"))

        return of

    kind = "array<struct<start:long,other:int,end:long,m:string,left:string,right:string>>"
    return rows.select(
        "key", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.concat(*[_places(F.col(k), i) for i, k in enumerate(KINDS)]).alias("base"),
        F.concat(F.transform("seeds", occurrence(True)), F.transform(F.when(F.size("others") > 0, apart(F.col("seeds"), F.col("others"))).otherwise(F.array().cast(kind)), occurrence(False))).alias("occurrences"),
    )


def few(patterns: DataFrame) -> DataFrame:
    """To be broadcast if there are few, else as it is."""
    return F.broadcast(patterns) if patterns.count() <= BROADCAST_PATTERNS else patterns


def ordinary(docs: DataFrame, induced: DataFrame, seen: DataFrame) -> DataFrame:
    """pattern, ordinary: how often something that is no occurrence stands where the patterns induced (pattern, first) say.

    Each word of each text is looked up by the word before it; those that may count are few.
    """
    words = F.split(_plain(F.coalesce(F.col("text"), F.lit(""))), BLANK)
    three = docs.select(words.alias("w")).select(F.inline(F.arrays_zip(F.concat(F.array(F.lit(""), F.lit("")), "w").alias("two"), F.concat(F.array(F.lit("")), "w").alias("one"), F.col("w").alias("word"))))
    mark = F.substring("word", 1, 1)
    three = three.where("word != '' and one != ''").select("two", "one", F.when(F.position(mark, F.lit(OPEN)) > 0, mark).otherwise(F.lit("")).alias("mark"))
    three = three.withColumn("first", first_context(F.col("one"), F.col("mark"))).join(few(induced.select("first").distinct()), "first", "left_semi")
    each = three.select(F.explode(F.array("first", second_context(F.col("two"), F.col("one"), F.col("mark")))).alias("pattern"))
    all_ = each.groupBy("pattern").agg(F.count("*").alias("all")).join(few(induced.select("pattern").distinct()), "pattern", "left_semi")
    mine = seen.groupBy("pattern").agg(F.count("*").alias("mine"))
    return all_.join(mine, "pattern", "left").select("pattern", F.greatest(F.lit(0), F.col("all") - F.coalesce("mine", F.lit(0))).alias("ordinary"))


def induce(edges: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """pattern, first of the patterns that enough distinct seeds have."""
    return edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.max("first").alias("first")).where(F.col("seeds") >= min_seeds).select("pattern", "first")


def confident(edges: DataFrame, others: DataFrame, turns: int = TURNS, min_score: float = MIN_SCORE) -> DataFrame:
    """pattern, pattern_score of the patterns that discover.

    edges: distinct (pattern, instance, seed) of induced patterns; others: pattern,
    ordinary. Scores are worked out again and again until none changes; they only grow, so
    they settle, and scores that have not after so many turns are an error, not a result. Without
    edges there are no patterns. Ties need no order, as all patterns that reach
    min_score discover.
    """
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).join(others, "pattern", "left").select("pattern", (F.col("n") + F.coalesce("ordinary", F.lit(0)) + DOUBT).alias("n"))
    size = common.stored(size, "pii-sizes")
    edges = common.stored(edges.select("pattern", "instance", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(PRIOR)).alias("score")), "pii-edges")
    scores, before = None, None
    for _ in range(turns):
        scores = edges.groupBy("pattern").agg(F.sum("score").alias("sum")).join(size, "pattern").select("pattern", (F.col("sum") / F.col("n")).alias("pattern_score"))
        scores = common.stored(scores, "pii-scores")
        if before is not None:
            moved = scores.join(before.withColumnRenamed("pattern_score", "was"), "pattern").where(F.abs(F.col("pattern_score") - F.col("was")) > SETTLED)
            if moved.isEmpty():
                break
        before = scores
        good = few(scores.where(F.col("pattern_score") >= min_score))
        best = edges.where("not seed").join(good, "pattern").groupBy("instance").agg(F.max("pattern_score").alias("best"))
        new = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(PRIOR))).alias("score")
        edges = common.stored(edges.join(best, "instance", "left").select("pattern", "instance", "seed", new), "pii-edges")
    else:
        raise RuntimeError(f"scores of patterns did not settle in {turns} turns")
    return scores.where(F.col("pattern_score") >= min_score)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_other for each row of docs (doc_id, text).

    A null text counts as empty: no spans. Repeated rows get equal results. A very
    long text is read whole. Discovered spans overlap no base span. Spans that
    begin together stand in the order of the kinds. Other columns, whatever their
    names, are not read. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    docs = common.texts(docs)
    rows = common.stored(read_texts(docs), "pii-rows")
    seen = rows.where(F.size("occurrences") > 0).select("key", F.explode("occurrences").alias("o"))
    seen = seen.select("key", "o.start", "o.end", "o.instance", "o.seed", "o.known", F.inline("o.patterns"))
    edges = common.stored(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("first").alias("first")), "pii-graph")
    induced = common.stored(induce(edges), "pii-induced")
    good = few(confident(edges.join(few(induced), "pattern", "left_semi"), ordinary(docs, induced.where("first is not null"), seen)))
    new = seen.where("not known").join(good, "pattern").select("key", "start", "end").distinct()
    new = new.groupBy("key").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("new"))  # one text's spans
    out = rows.join(new, "key", "left")
    names = (*KINDS, FOUND)
    added = F.coalesce(F.col("new"), F.array().cast("array<struct<start:long,kind:int,end:long>>"))
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_sorted_text(F.col("base"), names), 256).alias("base_sha256"),
        _sorted_text(F.concat(F.col("base"), added), names).alias("spans"), F.size(added).cast("long").alias("n_other"),
    )
