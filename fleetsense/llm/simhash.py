"""SimHash fingerprints, in DataFrame functions alone.

Terms of a text are its words and the pairs of words that follow one another, in
lower case. A pair weighs as much as it occurs, a word one. A term's 128 hashed
bits vote with its weight for or against each bit of the fingerprint. Two votes
share a 64-bit sum, so one pass over the terms needs a sum for each two bits.

Texts in the order of their ids: sampled splitters cut the order into buckets. A
splitter is itself a row's key, so each bucket begins with a row that is known, and
that row is dealt to the bucket before as well. Within a bucket a window
gives each row the next one, whatever the bucket's size; no row is ordered against all.

Fingerprints within a radius: cut into radius + 2 blocks, two fingerprints that differ
in `radius` bits at most agree in two blocks at least. Each pair of blocks is a
table, permuted so that these lead; fingerprints meet where they agree in a table's
lead, and are compared in the first table where they do.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, RADIUS = 128, 3
#: Buckets for each shuffle partition; buckets at most, so that the splitters stay small; keys sampled for each bucket.
BUCKETS, MOST, OVERSAMPLE = 4, 1 << 16, 4
#: Fingerprints of one lead that are compared in one row.
PART = 1024
#: Rows whose id this divides are queries; deals of the rows that share a fingerprint.
EVERY, DEALS = 20, 32
BLANK = r"[\x20\x09-\x0D]+"
#: Two 32-bit lanes of a sum.
_LANES = (1 << 32) + 1


def _key(doc_id: Column, text: Column) -> Column:
    """Falling ids, nulls last; rows that repeat an id by a hash of the text."""
    return F.struct(doc_id.isNull().cast("long").alias("a"), F.coalesce(F.bitwise_not(doc_id.cast("long")), F.lit(0).cast("long")).alias("b"), F.xxhash64(text).alias("c"))


def _splitters(keys: DataFrame, buckets: int) -> list:
    """Ascending keys of rows, the first of all among them; `buckets` of them or some more."""
    n = keys.count()
    every = max(1, n // (buckets * OVERSAMPLE))
    sample = keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).distinct().unionByName(keys.agg(F.min("key").alias("key"))).distinct()
    found = sorted(tuple(r.key) for r in sample.collect() if r.key is not None)  # some OVERSAMPLE for each bucket
    step = max(1, len(found) // buckets)
    return found[::step]


def _bucket(key: Column, splitters: Column, n: int) -> Column:
    """The number of the last splitter that is not after the key, by halving."""
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(widths, F.lit(0), lambda at, w: F.when((at + w < n) & (F.get(splitters, at + w) <= key), at + w).otherwise(at))


def followed(docs: DataFrame) -> DataFrame:
    """bucket, nth, real, doc_id, text, next: rows of docs with the next text by falling id; after the last comes the first.

    Rows that are not `real` stand for the first one of the bucket that follows.
    """
    rows = common.texts(docs).withColumn("key", _key(F.col("doc_id"), F.col("text")))
    parts = common.shuffle_parts(docs.sparkSession)
    splitters = _splitters(rows.select("key"), min(MOST, BUCKETS * parts))
    if not splitters:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("nth"), F.lit(True).alias("real"), "doc_id", "text", F.lit("").alias("next"))
    n = len(splitters)
    kind = "array<struct<a:long,b:long,c:long>>"
    table = F.lit("[" + ",".join("{%s}" % ",".join(f'"{f}":{v}' for f, v in zip("abc", s, strict=True)) for s in splitters) + "]")
    table = F.from_json(table, kind)
    rows = rows.withColumn("bucket", _bucket(F.col("key"), table, n))
    begins = F.col("key") == F.get(table, F.col("bucket"))
    # 0: in its own bucket. 1: as the end of the one before. 2: the first row of all, as the end of the last bucket.
    before = F.when(F.col("bucket") > 0, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("as"))).otherwise(F.struct(F.lit(n - 1).alias("bucket"), F.lit(2).alias("as")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("as"))
    dealt = rows.select("key", "doc_id", "text", F.inline(F.when(begins, F.array(own, before)).otherwise(F.array(own))))
    order = Window.partitionBy("bucket").orderBy("as", "key", "text")
    return dealt.select("bucket", F.row_number().over(order).alias("nth"), (F.col("as") == 0).alias("real"), "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the start of the following one, or all of that."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - third), F.left(following, third))


def terms(text: Column) -> Column:
    """Hashes of a text's distinct words and of its pairs of words, each as often as it occurs."""
    words = F.transform(F.filter(F.split(F.lower(text), BLANK), lambda w: w != ""), lambda w: F.xxhash64(w))
    bound = lambda x, use: F.get(F.transform(F.array(x), use), 0)  # noqa: E731  works x out once
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x))
    return bound(words, lambda w: F.concat(F.array_distinct(w), pairs(w)))


def votes(term: Column) -> list[Column]:
    """For each of 32 pairs of bits of both hashes of a term, a number that holds them in two lanes."""
    both = (term, F.when(term.isNotNull(), F.xxhash64(F.lit(7), term)))
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)) for h in both for k in range(32)]


def _word(sums: list[Column], n: Column) -> Column:
    """64 bits, of which those are set that more than half of the n votes are for."""
    low, high = (lambda s: s.bitwiseAND(F.lit((1 << 32) - 1))), (lambda s: F.shiftrightunsigned(s, 32))
    bit = lambda votes, k: F.when(votes * 2 > n, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
    out = F.lit(0).cast("long")
    for k, s in enumerate(sums):
        out = out.bitwiseOR(bit(low(s), k)).bitwiseOR(bit(high(s), k + 32))
    return out


def fingerprints(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, a, b: the two halves of the fingerprint of a column of texts; one row for each value of the keys, which are not null."""
    each = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("term"))
    found = each.select(*keys, F.col("term").isNotNull().cast("long").alias("one"), *[v.alias(f"v{i}") for i, v in enumerate(votes(F.col("term")))])
    sums = found.groupBy(*keys).agg(F.sum("one").alias("n"), *[F.coalesce(F.sum(f"v{i}"), F.lit(0).cast("long")).alias(f"v{i}") for i in range(64)])
    half = lambda h: _word([F.col(f"v{i}") for i in range(32 * h, 32 * h + 32)], F.col("n"))
    return sums.select(*keys, half(0).alias("a"), half(1).alias("b"))


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def likeness(bits: Column) -> Column:
    """The cosine of the angle that so many differing bits stand for, not below 0."""
    return F.greatest(F.lit(0.0), F.when(bits == 0, F.lit(1.0)).otherwise(F.cos(F.pi() * bits / BITS)))


def block_tables(radius: int = RADIUS) -> list[tuple[int, int]]:
    """For each pair of radius + 2 blocks the mask of its bits, as two signed 64-bit halves."""
    edges = [BITS * k // (radius + 2) for k in range(radius + 3)]
    blocks = [sum(1 << i for i in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed((x | y) & ((1 << 64) - 1)), signed((x | y) >> 64)) for x, y in itertools.combinations(blocks, 2)]


def within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b, n_within, least: for each fingerprint of a query how many rows of prints (doc_id, a, b, query) are within the radius, itself among them, and their least doc_id.

    Equal fingerprints are one row. What one lead holds is parted into rows of some PART
    fingerprints, and a query meets those of its own lead only.
    """
    spark = prints.sparkSession
    classes = common.stored(prints.groupBy("a", "b").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"), F.max("query").alias("query")), "simhash-classes")
    masks = block_tables(radius)
    lead = lambda m: F.struct(F.col("a").bitwiseAND(F.lit(m[0])).alias("la"), F.col("b").bitwiseAND(F.lit(m[1])).alias("lb"))
    led = classes.select("a", "b", "size", "least", "query", F.posexplode(F.array(*[lead(m) for m in masks])).alias("t", "lead")).select("t", "lead.*", "a", "b", "size", "least", "query")
    counts = led.groupBy("t", "la", "lb").agg(F.count("*").alias("n"), F.max("query").alias("asked")).where("asked and n > 1").select("t", "la", "lb", F.ceil(F.col("n") / PART).cast("long").alias("parts"))
    met = common.stored(led.join(counts, ["t", "la", "lb"]), "simhash-leads")
    blocks = met.groupBy("t", "la", "lb", F.pmod(F.xxhash64("a", "b"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("a", "b", "size", "least")).alias("others"))  # some PART
    asks = met.where("query").select("t", "la", "lb", F.col("a").alias("qa"), F.col("b").alias("qb"))
    tables = F.array(*[F.struct(F.lit(x).cast("long").alias("a"), F.lit(y).cast("long").alias("b")) for x, y in masks])

    def new(x: Column) -> Column:
        """Within the radius, and alike in no table before this one."""
        da, db = x["a"].bitwiseXOR(F.col("qa")), x["b"].bitwiseXOR(F.col("qb"))
        apart = F.forall(F.slice(tables, F.lit(1), F.col("t")), lambda m: (da.bitwiseAND(m["a"]) != 0) | (db.bitwiseAND(m["b"]) != 0))
        return F.when(F.bit_count(da) + F.bit_count(db) <= radius, apart & ((da != 0) | (db != 0))).otherwise(F.lit(False))

    near = asks.join(blocks, ["t", "la", "lb"]).select("qa", "qb", F.filter("others", new).alias("near"))
    near = near.select(F.col("qa").alias("a"), F.col("qb").alias("b"), F.aggregate("near", F.lit(0).cast("long"), lambda n, x: n + x["size"]).alias("size"), F.array_min(F.transform("near", lambda x: x["least"])).alias("least"))
    return near.unionByName(classes.where("query").select("a", "b", "size", "least")).groupBy("a", "b").agg(F.sum("size").alias("n_within"), F.min("least").alias("least"))


def shown(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within for each row of docs (doc_id, text).

    n_within is how many other rows have a fingerprint within RADIUS bits, asked for the rows
    whose doc_id is divisible by EVERY, else null.
    A null text counts as empty; without words the fingerprint is zero. The next row is
    that of the next lesser doc_id, null ids last; rows that repeat a doc_id follow one
    another by a hash of their texts. Of one row alone the next is itself. Very long texts are read
    whole. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    rows = followed(docs)
    rows = rows.select("bucket", "nth", "real", F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n_chars"), "text", edited(F.col("text"), F.col("next")).alias("edited"))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    marked = rows.select("bucket", "nth", "real", F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNull().alias("none"), "n_chars", "sha", F.inline(both))
    marked = marked.where("real or which = 0")
    prints = fingerprints(marked, "t", "bucket", "nth", "real", "id", "none", "n_chars", "sha", "which")
    pair = lambda k: F.max(F.when(F.col("which") == k, F.struct("a", "b")))
    one = prints.groupBy("bucket", "nth", "real", "id", "none", "n_chars", "sha").agg(pair(0).alias("own"), pair(1).alias("edited"))
    after = F.lead("own").over(Window.partitionBy("bucket").orderBy("nth"))
    query = F.coalesce(F.col("id") % EVERY == 0, F.lit(False)) & ~F.col("none")
    one = common.stored(one.withColumn("after", after).where("real").withColumn("query", query), "simhash-prints")
    near = within(one.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "own.a", "own.b", "query"))
    # A fingerprint may be that of very many rows: they are dealt out, and what is found for it goes to each of the deals.
    near = near.select(F.col("a").alias("na"), F.col("b").alias("nb"), "n_within", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = F.pmod(F.xxhash64("id", "sha"), F.lit(DEALS)).cast("int")
    one = one.withColumn("of", dealt).join(near, F.expr("own.a = na AND own.b = nb AND of = deal"), "left")
    bits = lambda x: distance(F.col("own.a"), F.col("own.b"), F.col(f"{x}.a"), F.col(f"{x}.b"))
    return one.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), shown(F.col("own.a"), F.col("own.b")).alias("fingerprint"),
        shown(F.col("edited.a"), F.col("edited.b")).alias("edited_fingerprint"), likeness(bits("edited")).alias("near_edited"), likeness(bits("after")).alias("near_next"),
        F.when(F.col("query"), F.col("n_within") - 1).alias("n_within"),
    )
