"""Spelling variants: words that differ by one code point, found in wildcard groups without listing pairs.

1. Words are counted over all texts and ranked by falling number, then code-point
   order, so that a word is a number and the better of two words the lesser one.
2. Each word names one group for each of its places: its length, the place and the
   text around it. Words of one group differ just there, so a group has no more
   words than the alphabet has letters (90), and two words share one group at most.
   A group's size and its two best words say what each member needs.
3. A word with one code point less is looked up among the words: deletions join the
   vocabulary. A run of equal letters gives one deletion.
4. Both are summed by word. Forms lead to words of five times the number and more,
   so the way to the root is short: it is halved in each turn.

A text around a place is named by two 64-bit sums over its code points and their
places, so a name costs the same at any place of a word of any length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import mixed

#: A run of letters; what counts as a letter here.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
DAMAGE = 199
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Code points whose names are worked out at once; a longer word is taken alone.
CHARS = 1 << 18
#: Characters that words of one number are dealt out by: what is sampled for it goes to the driver.
PREFIX = 32
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def runs(docs: DataFrame) -> DataFrame:
    """word for each run of the texts that has MIN_CHARS code points and more, some of them damaged."""
    found = common.texts(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    found = found.where(F.length("run") >= MIN_CHARS).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h: Column = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_CHARS)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """rank, word, n: a lesser rank for a larger number, then for what comes first in code-point order."""
    counted = runs(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    counted = common.stored(counted, "spelling-words")
    parts = common.shuffle_parts(docs.sparkSession)
    dealt = counted.withColumn("prefix", F.left("word", F.lit(PREFIX))).repartitionByRange(parts, F.desc("n"), "prefix").sortWithinPartitions(F.desc("n"), "word")
    # Numbers of rows within ranges that follow one another are in the order of the whole.
    return common.stored(dealt.select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "spelling-ranks")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in turn, each one's place in its word, and the words' bounds."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return codes, np.arange(len(codes)) - np.repeat(bounds[:-1], sizes), bounds


def _votes(codes: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    return mixed(codes + (place.astype(np.uint64) << np.uint64(21)) + np.uint64(seed))


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


def wildcards(words: list[str]):
    """(owner, length, place, a, b): the group of each word for each of its places."""
    codes, place, bounds = _letters(words)
    sizes = np.diff(bounds)
    names = []
    for seed in _SEEDS:
        vote = _votes(codes, place, seed)
        total = np.diff(_before(vote)[bounds])
        names.append(np.repeat(total, sizes) - vote)
    owner = np.repeat(np.arange(len(words)), sizes)
    return owner, sizes[owner], place, *names


def whole(words: list[str]):
    """(length, a, b) of each word."""
    codes, place, bounds = _letters(words)
    return np.diff(bounds), *[np.diff(_before(_votes(codes, place, seed))[bounds]) for seed in _SEEDS]


def deletions(words: list[str]):
    """(owner, length, a, b): what whole() gives for each word without one of its code points, each result once."""
    codes, place, bounds = _letters(words)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)  # within a run of equal letters, whichever goes
    at = np.flatnonzero(first)
    owner = owner[at]
    names = []
    for seed in _SEEDS:
        left = _before(_votes(codes, place, seed))
        right = _before(_votes(codes, np.maximum(place - 1, 0), seed))  # one place nearer to the start
        names.append(left[at] - left[bounds[owner]] + right[bounds[owner + 1]] - right[at + 1])
    return owner, sizes[owner] - 1, *names


def _batched(ranked: DataFrame, schema: str, make) -> DataFrame:
    """Rows of make(ranks, words), for words of some CHARS code points at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "word", CHARS):
            ranks = batch.column("rank").to_numpy()
            for columns in make(ranks, batch.column("word").to_pylist()):
                for at in range(0, len(columns[0]), CHARS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + CHARS].astype(np.int64)) for c in columns], names)

    return ranked.select("rank", "word").mapInArrow(run, schema)


def by_replacement(ranked: DataFrame) -> DataFrame:
    """rank, near, best: how many words differ by one replaced code point, and the best of them."""

    def make(ranks, words):
        owner, *rest = wildcards(words)
        yield ranks[owner], *rest

    named = _batched(ranked, "rank long, length long, place long, a long, b long", make)
    groups = named.groupBy("length", "place", "a", "b").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))  # a letter each: 90 at most
    groups = groups.where(F.size("ranks") > 1).select((F.size("ranks") - 1).cast("long").alias("near"), F.get("ranks", F.lit(0)).alias("top"), F.get("ranks", F.lit(1)).alias("second"), F.explode("ranks").alias("rank"))
    return groups.select("rank", "near", F.when(F.col("rank") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))


def by_indel(ranked: DataFrame) -> DataFrame:
    """rank, near, best, one row for each word with one code point more or less."""

    def shorter(ranks, words):
        owner, *rest = deletions(words)
        yield ranks[owner], *rest

    def same(ranks, words):
        yield ranks, *whole(words)

    short = _batched(ranked, "rank long, length long, a long, b long", shorter)
    full = _batched(ranked, "short long, length long, a long, b long", same)
    met = short.join(full, ["length", "a", "b"]).select("rank", "short")  # a deletion is one word or none
    return met.select(F.inline(F.array(F.struct("rank", F.lit(1).cast("long").alias("near"), F.col("short").alias("best")), F.struct(F.col("short").alias("rank"), F.lit(1).cast("long").alias("near"), F.col("rank").alias("best")))))


def roots(forms: DataFrame) -> DataFrame:
    """rank, root: the last word on the way over forms (rank, form); each turn halves what is left of it."""
    at = common.stored(forms.select("rank", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        at = common.stored(at.join(on, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.select("rank", "root")


def variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text) that occurs min_count times.

    A null or empty text has no words; a null doc_id counts as an empty one. Rows
    that repeat count as often as they stand. Ties of n go to what comes first in
    code-point order. Very long texts and words are read whole; other columns, whatever
    their names, are not read. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word, or forms could lead in a circle")
    common.small_batches(docs.sparkSession)
    ranked = vocabulary(docs, min_count)
    near = by_replacement(ranked).unionByName(by_indel(ranked)).groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    rows = ranked.join(near, "rank", "left").join(best, "best", "left")
    taken = F.col("best_n") >= ratio * F.col("n")
    rows = rows.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best")).alias("to"), F.when(taken, F.col("best_word")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    rows = common.stored(rows, "spelling-near")
    last = roots(rows.where("to is not null").select("rank", F.col("to").alias("form"))).join(ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    out = rows.join(last, "rank", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
