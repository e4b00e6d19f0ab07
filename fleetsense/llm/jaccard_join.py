"""Exact Jaccard self-join on word shingles, by a token-group matrix.

1. A text's set is its distinct 5-word shingles, as 64-bit hashes. Equal sets
   become one document.
2. Groups: documents that agree in a pair of min-hashes are compared with the
   first of them; those that are alike by half of what a link takes form groups.
   Groups decide what is compared where, not what links. Those that link already
   form classes within a group, whose members need not be compared with one another.
3. Tokens (shingles) are put in one global order, the rare ones first: all tokens
   of all documents are counted, near copies once, into a table of fixed size that
   holds a class of frequency for each hash class of tokens.
4. The matrix: for each token the groups in whose members' prefixes it stands. A
   prefix is so many of a set's first tokens in the order that two sets which link
   share one. A cell keeps the sizes of the members, so groups too unlike in size
   do not meet. A token of few groups gives their pairs; one of many is a hub that
   names its groups once, so a cell gives at most HUB rows.
5. A group's or hub's members, in parts of bounded size, give a token union; a
   document opens a part only if its overlap with the union can reach the
   similarity. In an open part the token lists count its overlap with each member.
   Large classes have parts of their own, small ones share parts. Members of a shared
   part are held against one another, and documents of the other parts and of the
   groups that the matrix names against all. A part gives only links that
   join what it has not joined yet, so fewer than it has documents. A part that many
   documents ask is dealt out in several copies.
6. Components of all links.

No step emits the pairs of a group or of a token's groups, and none needs more of
a group in one place than a part. Near copies that link cost what their number is;
m documents that are alike but do not link, in one group or hub, are sent to
m / PART parts each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, hashing

WORDS = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Documents of one key are alike from this similarity on.
ALIKE = 40
KEYS = 3
#: Bits of a token's hash class, and the numbers of kinds of documents from which on the next class of frequency begins (two bits).
CLASS_BITS, CLASSES = 26, (2, 16, 256)
_BLOCK_BITS = 18
#: Groups of one token from which on it is a hub.
HUB = 64
#: Members of a part; documents that ask a copy of it, about; documents compared with one first document in one task.
PART, ASKERS, STAR = 512, 2048, 128
#: Bits of the filter that says which texts are needed; beyond what it can tell apart, more texts than needed are sent.
NEED_BITS = 24
#: Text of a batch, and what of it is hashed at once: hashing takes some 40 times the bytes that it is given.
BATCH_BYTES, HASH_BYTES = 2 << 20, 256 << 10
_SEEDS = [int(x) for x in (np.arange(1, 2 * KEYS + 1, dtype=np.uint64) * hashing.MIX) | np.uint64(1)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column, words: int = WORDS) -> list[np.ndarray]:
    """Each text's ascending distinct shingle hashes (a text of fewer words: one, of all its words; without words: none)."""
    data, bounds = hashing.buffer(column)
    out, at = [], 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + HASH_BYTES, "right")) - 1)
        out += _sets(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at], words)
        at = end
    return out


def _sets(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    _, _, h, cuts = hashing.words_of(_LOWER[data], bounds)
    n = len(h)
    out = []
    if n >= words:
        s = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            s += h[k : n - words + 1 + k] * hashing.POWERS[k + 1]
        s = hashing.mixed(s)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            out.append(hashing.mixed(np.array([(h[a:b] * hashing.POWERS[1 : b - a + 1]).sum() + np.uint64(b - a)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    """Tokens among which a set of n shares one with each set that it links with."""
    return n - -(-NUM * n // DEN) + 1


def short_size(n: int) -> int:
    """The same, where the other set has n tokens or more: the overlap is 2s/(1+s) of n at least."""
    return n - -(-2 * NUM * n // (NUM + DEN)) + 1


def _class_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)


def frequency(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each token's class of frequency (0 to 3) by a table of two bits for each hash class."""
    at = _class_of(tokens)
    return table[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & np.uint8(3)


def ordered_prefix(tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first prefix_size tokens in the global order: by class of frequency, then by hash."""
    p = prefix_size(len(tokens))
    if not often[:p].any():
        return tokens[:p]
    return tokens[np.argsort(often, kind="stable")[:p]]


SIGNATURE = "doc_id long, n long, d1 long, d2 long, keys array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """For each row its set's size, digest and keys."""

    def run(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text"))
            n = np.array([len(x) for x in sets], np.int64)
            d1, d2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            keys = np.zeros((len(sets), KEYS), np.int64)
            some = np.flatnonzero(n)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                at = np.cumsum(n[some]) - n[some]
                d1[some] = np.add.reduceat(hashing.mixed(flat + np.uint64(1)), at).view(np.int64)
                d2[some] = np.bitwise_xor.reduceat(hashing.mixed(flat ^ hashing.MIX), at).view(np.int64)
                least = [np.minimum.reduceat(hashing.mixed(flat ^ np.uint64(s)), at) for s in _SEEDS]
                for k in range(KEYS):
                    keys[some, k] = hashing.mixed(least[2 * k] * np.uint64(3) + least[2 * k + 1] + np.uint64(k)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(d1), pa.array(d2), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "keys"]
            )

    return docs.mapInArrow(run, SIGNATURE)


def _cut(bucket: np.ndarray, *columns: np.ndarray):
    """A row for each bucket: its number and its entries of each column as bytes. The entries keep their order."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    ids, at = np.unique(bucket, return_index=True)
    ends = np.append(at[1:], len(bucket))
    out = [pa.array(ids.astype(np.int64))]
    for x in columns:
        x = x[order]
        out.append(pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", "tokens", "counts"][: len(out)])


def buckets(batches, *columns: str):
    """The blobs of each column, in lists, for one bucket after another of batches sorted by bucket. A list may be cleared once it is read."""
    held, current = [[] for _ in columns], None
    for batch in batches:
        for b, *blobs in zip(*(batch.column(k).to_pylist() for k in ("bucket", *columns))):
            if b != current and held[0]:
                yield held
                held = [[] for _ in columns]
            current = b
            for into, blob in zip(held, blobs):
                into.append(blob)
    if held[0]:
        yield held
    common.trim()


def frequency_table(docs: DataFrame, parts: int) -> np.ndarray:
    """Two bits for each of 2**CLASS_BITS hash classes of tokens: how many kinds of documents have it, by CLASSES.

    All tokens of all documents are counted. A document's kind is 16 bits of a
    min-hash, on which near copies mostly agree, so a group's own tokens are not
    taken for frequent ones. Pairs of token and kind are made distinct where both
    decide the place, so a token of very many documents is counted by all tasks;
    the counts are summed by token. The table's size does not depend on the input.
    """
    kind_bits = np.uint64(16)
    seed = np.uint64(_SEEDS[0])

    def pairs(batches):
        for batch in common.sized(batches, "text", BATCH_BYTES):
            sets = [x for x in shingle_sets(batch.column("text")) if len(x)]
            if sets:
                n = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets)
                kind = np.minimum.reduceat(hashing.mixed(flat ^ seed), np.cumsum(n) - n) >> np.uint64(48)
                both = np.unique(_class_of(flat).astype(np.uint64) << kind_bits | np.repeat(kind, n))
                six = np.ascontiguousarray(both).view(np.uint8).reshape(-1, 8)[:, :6]  # little-endian: 42 bits are used
                yield _cut((hashing.mixed(both) >> np.uint64(33)).astype(np.int64) % (2 * parts), six)

    def count(batches):
        """Kinds of each token, a bucket at a time: what a task holds at once is half a part, however many buckets it is dealt."""
        for (blobs,) in buckets(batches, "tokens"):
            six = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
            blobs.clear()
            wide = np.zeros((len(six), 8), np.uint8)
            wide[:, :6] = six
            del six
            both = wide.view(np.uint64).ravel()
            both.sort()  # in place: np.unique would hold a hash table of them
            token = both[np.append(True, both[1:] != both[:-1])] >> kind_bits
            del wide, both
            at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            token, n = token[at], np.diff(at, append=len(token))
            yield _cut((token >> np.uint64(_BLOCK_BITS)).astype(np.int64), token.astype(np.uint32), n.astype(np.uint32))

    def total(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, tokens, n in zip(*(batch.column(k).to_pylist() for k in ("bucket", "tokens", "counts"))):
                into = sums.setdefault(block, np.zeros(1 << _BLOCK_BITS, np.int64))
                at = np.frombuffer(tokens, np.uint32).astype(np.int64) & ((1 << _BLOCK_BITS) - 1)  # distinct in a blob
                into[at] += np.frombuffer(n, np.uint32)
        for block, n in sums.items():
            often = np.searchsorted(np.array(CLASSES), n, "right").astype(np.uint8).reshape(-1, 4)
            packed = np.bitwise_or.reduce(often << np.arange(0, 8, 2, dtype=np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed.tobytes()], pa.binary())], ["block", "often"])
        common.trim()

    dealt = docs.where("doc_id is not null").mapInArrow(pairs, "bucket long, tokens binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(count, "bucket long, tokens binary, counts binary").repartition(parts, "bucket")
    table = np.zeros((1 << CLASS_BITS - _BLOCK_BITS, 1 << _BLOCK_BITS - 2), np.uint8)
    for r in counted.mapInArrow(total, "block long, often binary").collect():  # 2**(CLASS_BITS - _BLOCK_BITS) rows at most, 16 MB
        table[r["block"]] = np.frombuffer(r["often"], np.uint8)
    return table.ravel()


def need_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each class of the ids: a few MB, whatever their number."""
    at = f"pmod(doc_id, {1 << NEED_BITS}L)"
    words = ids.select(F.expr(f"shiftright({at}, 5)").alias("word"), F.expr(f"shiftleft(1L, CAST({at} % 32 AS INT))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2**NEED_BITS / 32 rows at most
    bits = np.zeros(1 << (NEED_BITS - 5), np.uint32)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits.view(np.uint8)


def needed(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows of docs (doc_id, text) whose id may be needed."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column("doc_id").fill_null(0)) % (1 << NEED_BITS)
            yield batch.filter(pa.array((bits[x >> 3] >> (x & 7) & 1).astype(bool)))

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, text string")


class Part:
    """Members of a part: their token union, each token's members, and what has been joined."""

    def __init__(self):
        self.docs: list[int] = []
        self.sets: list[np.ndarray] = []
        self.union = None
        self.root: dict[int, int] = {}

    def add(self, doc: int, tokens: np.ndarray) -> None:
        if len(tokens):
            self.docs.append(doc)
            self.sets.append(tokens)

    def close(self) -> None:
        if self.union is None and self.sets:
            size = np.array([len(x) for x in self.sets], np.int64)
            token, member = np.concatenate(self.sets), np.repeat(np.arange(len(size)), size)
            order = np.argsort(token, kind="stable")
            token, self.member = token[order], member[order]
            at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            self.union, self.start, self.end = token[at], at, np.append(at[1:], len(token))
            self.size = size

    def alike(self, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Members with DEN * intersection >= least * union, and whether they link."""
        none = np.empty(0, np.int64), np.empty(0, bool)
        if self.union is None or not len(tokens):
            return none
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == tokens]
        if DEN * len(at) < least * len(tokens):  # the bound: no member shares more than the union does
            return none
        n = self.end[at] - self.start[at]
        pos = np.arange(int(n.sum())) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        both = np.bincount(self.member[pos], minlength=len(self.size))
        any_ = self.size + len(tokens) - both
        found = np.flatnonzero(DEN * both >= least * any_)
        return found, (DEN * both >= NUM * any_)[found]

    def _find(self, x: int) -> int:
        while self.root.get(x, x) != x:
            self.root[x] = self.root.get(self.root[x], self.root[x])
            x = self.root[x]
        return x

    def joins(self, doc: int, found: tuple[np.ndarray, np.ndarray]):
        """doc, member, whether they link: those that join what was apart."""
        for m, near in zip(found[0].tolist(), found[1].tolist()):
            a, b = self._find(doc), self._find(self.docs[m])
            if a != b:
                self.root[max(a, b)] = min(a, b)
                yield doc, self.docs[m], near


#: What a document is to a part: a member held against the others, a member that is only asked, or one that asks the members.
MEMBER, ASKED, ASKS = 0, 1, 2


def compare(docs: DataFrame, asked: DataFrame, least: int = NUM) -> DataFrame:
    """u, v, near (whether they link): documents alike among asked (part, role, doc_id), of which a part's members have one role."""
    spark = docs.sparkSession
    rows = needed(docs, need_filter(asked)).join(asked, "doc_id").select("part", "role", "doc_id", "text")
    rows = rows.repartition(common.shuffle_parts(spark), "part").sortWithinPartitions("part", "role", "doc_id")

    def run(batches):
        import pyarrow as pa

        name, part, within, out = None, Part(), False, []

        def finish() -> None:
            """Close the part and hold its members against one another."""
            if part.union is None and part.docs:
                sets = list(part.sets)
                part.close()
                if within and len(sets) > 1:
                    for doc, tokens in zip(list(part.docs), sets):
                        out.extend(part.joins(doc, part.alike(tokens, least)))
                part.sets = []

        def given():
            u, v, near = (list(x) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(near, pa.bool_())], ["u", "v", "near"])

        for batch in common.sized(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text"))
            for p, role, doc, tokens in zip(batch.column("part").to_pylist(), batch.column("role").to_pylist(), batch.column("doc_id").to_pylist(), sets):
                if p != name:
                    finish()
                    name, part, within = p, Part(), role == MEMBER
                if role != ASKS:
                    part.add(doc, tokens)
                    continue
                finish()
                out.extend(part.joins(doc, part.alike(tokens, least)))
            if out:
                yield given()
        finish()
        if out:
            yield given()

    return rows.mapInArrow(run, "u long, v long, near boolean")


def star_pairs(distinct: DataFrame) -> DataFrame:
    """part, role, doc_id: each document that shares a key with lesser ones is held against the least of them."""
    keyed = distinct.select("doc_id", "n", F.posexplode("keys").alias("which", "key"))
    first = keyed.groupBy("which", "key").agg(F.min(F.struct("doc_id", "n")).alias("f"), F.count("*").alias("rows")).where("rows > 1")
    pairs = keyed.join(first.select("which", "key", "f"), ["which", "key"]).where("doc_id > f.doc_id").where(DEN * F.least("n", F.col("f.n")) >= ALIKE * F.greatest("n", F.col("f.n")))
    pairs = pairs.select(F.col("f.doc_id").alias("first"), "doc_id").distinct()
    pairs = pairs.join(pairs.groupBy("first").agg(F.count("*").alias("rows")), "first")
    pairs = pairs.select("first", "doc_id", F.pmod(F.xxhash64("doc_id"), F.expr(f"1 + rows div {STAR}")).alias("salt"))
    part = F.concat_ws("/", "first", "salt").alias("part")
    asks = pairs.select(part, F.lit(ASKS).alias("role"), "doc_id")
    firsts = pairs.select("first", "salt").distinct().select(part, F.lit(ASKED).alias("role"), F.col("first").alias("doc_id"))
    return asks.unionByName(firsts)


def matrix(docs: DataFrame, groups: DataFrame, table: np.ndarray, parts: int) -> DataFrame:
    """hub, g1, g2: groups that share a prefix token of members whose sizes are near enough (g1 < g2).

    A token of HUB groups or more gives a row for each of them instead (hub, g1,
    and null): tokens of the same groups are the same hub. groups: doc_id and
    group of the distinct documents.
    """

    def prefixes(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text"))
            n = np.array([len(x) for x in sets], np.int64)
            ends = np.cumsum(n)
            often = frequency(np.concatenate(sets), table) if len(sets) else np.empty(0, np.uint8)
            blobs = [ordered_prefix(x, often[e - len(x) : e]).tobytes() if len(x) else None for x, e in zip(sets, ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(blobs, pa.binary())], ["doc_id", "n", "tokens"])

    rows = docs.where("doc_id is not null").mapInArrow(prefixes, "doc_id long, n long, tokens binary").where("tokens is not null").join(groups, "doc_id")

    def cells(batches):
        """Blobs of (token, group, size twice plus whether it is among the short prefix), by the token's bucket."""
        import pyarrow as pa

        for batch in batches:
            blobs = batch.column("tokens").to_pylist()
            n = np.asarray(batch.column("n"))
            token = np.frombuffer(b"".join(blobs), np.uint64)
            size = np.array([len(b) // 8 for b in blobs], np.int64)
            group = np.repeat(np.asarray(batch.column("group")), size)
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            short = place < np.repeat(np.array([short_size(k) for k in n.tolist()], np.int64), size)
            mark = np.repeat(2 * n, size) + short
            bucket = ((token >> np.uint64(CLASS_BITS)) % np.uint64(2 * parts)).astype(np.int64)
            order = np.lexsort((mark, group, token, bucket))
            bucket, token, group, mark = bucket[order], token[order], group[order], mark[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1]) | (mark[1:] != mark[:-1])
            bucket, token, group, mark = bucket[new], token[new], group[new], mark[new]
            ids, at = np.unique(bucket, return_index=True)
            ends = np.append(at[1:], len(bucket))
            cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(at, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), cut(token, np.uint64), cut(group, np.int64), cut(mark, np.uint32)], ["bucket", "token", "group", "mark"])

    dealt = rows.mapInArrow(cells, "bucket long, token binary, group binary, mark binary").repartition(parts, "bucket").sortWithinPartitions("bucket")

    def meet(batches):
        for blobs in buckets(batches, "token", "group", "mark"):
            yield from met(blobs)

    def met(blobs):
        token, group, mark = (np.frombuffer(b"".join(x), t) for x, t in zip(blobs, (np.uint64, np.int64, np.uint32)))
        blobs.clear()
        order = np.lexsort((mark, group, token))
        token, group, mark = token[order], group[order], mark[order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.append(edge[1:], len(token))
        found, rows = [], 0
        for a, b in zip(edge.tolist(), ends.tolist()):
            if group[a] == group[b - 1]:  # sorted by group: there is but one
                continue
            names = np.unique(group[a:b])
            if len(names) >= HUB:
                hub = hashing.mixed(names.view(np.uint64)).sum().view(np.int64)
                found.append(np.stack([np.full(len(names), hub), names, np.full(len(names), -1), np.ones(len(names), np.int64)], 1))
            else:  # by size: each cell of a short prefix meets those of no lesser size, up to what can link
                sub = np.argsort(mark[a:b] >> 1, kind="stable") + a
                g, n, short = group[sub], mark[sub] >> 1, (mark[sub] & 1).astype(bool)
                pairs = []
                for i in np.flatnonzero(short).tolist():
                    lo, hi = np.searchsorted(n, n[i], "left"), np.searchsorted(n, n[i] * DEN // NUM, "right")
                    other = np.unique(g[lo:hi])
                    other = other[other != g[i]]
                    if len(other):
                        pairs.append(np.stack([np.zeros(len(other), np.int64), np.minimum(other, g[i]), np.maximum(other, g[i]), np.zeros(len(other), np.int64)], 1))
                if not pairs:
                    continue
                found.append(np.unique(np.concatenate(pairs), axis=0))
            rows += len(found[-1])
            if rows > 250_000:
                yield given(found)
                found, rows = [], 0
        if found:
            yield given(found)

    def given(found):
        import pyarrow as pa

        x = np.unique(np.concatenate(found), axis=0)
        none = x[:, 3] == 1
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0], mask=~none), pa.array(x[:, 1]), pa.array(x[:, 2], mask=none)], ["hub", "g1", "g2"])

    return dealt.mapInArrow(meet, "hub long, g1 long, g2 long").distinct()


def opened(met: DataFrame, groups: DataFrame) -> DataFrame:
    """part, role, doc_id: members of groups and hubs in parts, and the documents that ask them.

    groups: doc_id, group and class, the documents of a class being linked already. A
    store is a group's or hub's class of PART members or more, or all its lesser
    classes together; it has a part for each PART members, a class in one. A document
    asks the stores of its group or hub that come after its own, and in a store of
    lesser classes the parts after its own; of a pair of groups the smaller one asks
    all parts of the larger one. A part is copied for each ASKERS of its askers, of
    which one copy holds its members against one another. Parts of one class that
    nobody asks are left out.
    """
    of_groups = groups.select(F.concat(F.lit("group "), "group").alias("name"), "doc_id", "class")
    of_hubs = met.where("hub is not null").select("hub", F.col("g1").alias("group")).join(groups, "group").select(F.concat(F.lit("hub "), "hub").alias("name"), "doc_id", "class")
    named = common.stored(of_groups.unionByName(of_hubs), "join-named")
    classes = named.groupBy("name", "class").agg(F.count("*").alias("n"))
    store = F.when(F.col("n") >= PART, F.col("class"))  # null: the lesser classes, which come first
    stores = classes.groupBy("name", store.alias("store")).agg(F.sum("n").alias("n"), F.count("*").alias("classes")).withColumn("n_parts", F.expr(f"1 + n div {PART}"))
    stores = common.stored(stores, "join-stores")
    held = named.join(classes, ["name", "class"]).withColumn("store", store).drop("n")
    held = held.join(stores.withColumnRenamed("name", "of").withColumnRenamed("store", "its"), (F.col("name") == F.col("of")) & F.col("store").eqNullSafe(F.col("its")))
    key = F.when(F.col("store").isNull(), F.xxhash64("class")).otherwise(F.xxhash64("doc_id"))
    held = common.stored(held.select("name", "store", "doc_id", "n_parts", "classes", F.pmod(key, F.col("n_parts")).alias("k")), "join-held")
    part = lambda k: F.concat_ws("/", "name", F.coalesce(F.col("store").cast("string"), F.lit("lesser")), k).alias("part")

    own = held.where("store is null and k < n_parts - 1").select("name", "store", "doc_id", F.explode(F.expr("sequence(k + 1, n_parts - 1)")).alias("j"))
    several = stores.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    later = held.join(several, "name", "left_semi").select("name", F.col("store").alias("mine"), "doc_id").join(stores.select("name", "store", "n_parts"), "name")
    later = later.where("store is not null and (mine is null or mine < store)").select("name", "store", "doc_id", F.explode(F.expr("sequence(0, n_parts - 1)")).alias("j"))

    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    p = met.where("hub is null").join(sizes.select(F.col("group").alias("g1"), F.col("members").alias("m1")), "g1")
    p = p.join(sizes.select(F.col("group").alias("g2"), F.col("members").alias("m2")), "g2")
    first = F.col("m1") >= F.col("m2")
    p = p.select(F.concat(F.lit("group "), F.when(first, F.col("g1")).otherwise(F.col("g2"))).alias("name"), F.when(first, F.col("g2")).otherwise(F.col("g1")).alias("group"))
    pairs = p.join(groups.select("group", "doc_id"), "group").select("name", "doc_id").distinct()
    pairs = pairs.join(stores.select("name", "store", "n_parts"), "name").select("name", "store", "doc_id", F.explode(F.expr("sequence(0, n_parts - 1)")).alias("j"))

    asks = common.stored(own.unionByName(later).unionByName(pairs).select(part("j"), "doc_id"), "join-asks")
    copies = asks.groupBy("part").agg(F.expr(f"1 + count(*) div {ASKERS}").alias("copies"))
    asks = asks.join(copies, "part").select(F.concat_ws("/", "part", F.pmod(F.xxhash64("doc_id", F.lit(1)), "copies")).alias("part"), F.lit(ASKS).alias("role"), "doc_id")
    members = held.select(part("k"), "doc_id", (F.col("store").isNull() & (F.col("classes") > 1)).alias("several")).join(copies, "part", "left").where("several or copies is not null")
    members = members.select("part", "doc_id", "several", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    role = F.when((F.col("copy") == 0) & F.col("several"), MEMBER).otherwise(ASKED).alias("role")
    return members.select(F.concat_ws("/", "part", "copy").alias("part"), role, "doc_id").unionByName(asks)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    A null text counts as empty. A document without words links with nothing.
    Rows that repeat a doc_id are one document: what either links with, both do.
    A null doc_id links with nothing and has a null component. A very long text is
    hashed whole, alone in its batch. Components do not depend on the order of the
    rows; the least doc_id names one, so there are no ties. Other columns, whatever
    their names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    docs, parts = common.texts(docs), common.shuffle_parts(spark)
    rows = common.stored(signatures(docs), "join-signatures")
    sets = rows.where("n > 0 and doc_id is not null")
    distinct = common.stored(sets.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "keys")).alias("f")).select("n", "d1", "d2", "f.doc_id", "f.keys"), "join-distinct")
    equal = sets.join(distinct.select("n", "d1", "d2", F.col("doc_id").alias("v")), ["n", "d1", "d2"]).where("doc_id != v").select(F.col("doc_id").alias("u"), "v")
    alike = common.stored(compare(docs, common.stored(star_pairs(distinct), "join-stars"), ALIKE), "join-alike")
    near = alike.where("near").select("u", "v")
    grouped, linked = graph.components(alike.select("u", "v")), graph.components(near)
    groups = distinct.select("doc_id").distinct()
    groups = groups.join(grouped.select(F.col("node").alias("doc_id"), F.col("root").alias("group")), "doc_id", "left").join(linked.select(F.col("node").alias("doc_id"), F.col("root").alias("class")), "doc_id", "left")
    groups = common.stored(groups.select("doc_id", F.coalesce("group", "doc_id").alias("group"), F.coalesce("class", "doc_id").alias("class")), "join-groups")
    met = common.stored(matrix(docs, groups.select("doc_id", "group"), frequency_table(docs, parts), parts), "join-met")
    asked = common.stored(opened(met, groups), "join-asked")
    roots = graph.components(compare(docs, asked).select("u", "v").unionByName(near).unionByName(equal))
    return rows.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of its component; others go.

    Rows that repeat such a doc_id stay, as do rows with a null doc_id. Null and
    empty texts link with nothing and stay. An empty table gives no rows. Columns
    of docs may have any name.
    """
    stays = common.free("stays", docs)
    found = near_duplicates(docs).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias(stays)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(stays)), "left_semi")
