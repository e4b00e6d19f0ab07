"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (projections and MLP,
attention). Whole multiples of the capacity are sequences by themselves. What
remains of the documents is sorted by length and each, the longest first, goes to
the lowest-cost of all sequences that have room for the whole of it. Where none has,
the lowest-cost sequence with any room is filled, and what is left of the document
waits its turn by its new length. A task packs its rows in groups of some 4 MB of
text into as many sequences as the group fills; what is left over, the shortest
pieces, less than a sequence, goes on to the next group. So a task has one tail, in
power-of-two lengths that need no padding, and needs little memory; nothing is
shuffled, and a task that runs again packs alike.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .tokens import WORD_BPE, encoder, tokenizer_path

MAX_TOKENS = 4096
END_ID = 2
#: FLOPs of a layer of width 1024, scaled: 24 d^2 n + 4 d n^2, over 4 d.
LINEAR, QUADRATIC = 6144.0, 1.0
#: Sequence ids of a task begin at its partition's number shifted by so many bits.
TASK_BITS = 36

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
)


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def capacities(tokens: int, size: int) -> list[int]:
    """Sequences that hold just `tokens`: full ones, then powers of two for the rest (size is a power of two, or the rest is one sequence)."""
    full, rest = divmod(tokens, size)
    out = [size] * full
    if size & (size - 1):
        return out + [rest] * (rest > 0)
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], size: int, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[float], list[tuple[int, int, int]]]:
    """Pieces (document, start, length, sequence, offset), each sequence's cost, and what is left over (document, start, length).

    Every token of every document is in one piece or left over, every sequence is
    full. Unless it is the last call, only sequences of the full size are made,
    and less than one is left over. Documents of no tokens have no piece. Ties go to
    the earlier document and the earlier sequence.
    """
    pieces, costs, wait = [], [], []
    for d, n in enumerate(lengths):
        for k in range(n // size):
            pieces.append((d, k * size, size, len(costs), 0))
            costs.append(cost(size))
        if n % size:
            wait.append((-(n % size), d, n - n % size))
    heapq.heapify(wait)  # the longest first
    tokens = -sum(n for n, _, _ in wait)
    room = capacities(tokens, size) if last else [size] * (tokens // size)
    first = len(costs)
    costs += [0.0] * len(room)
    free = list(room)
    open_ = [(0.0, s) for s in range(len(room)) if free[s] == size]  # those with room for the piece in turn, the cheapest first
    small: list[list[int]] = [[] for _ in range(size + 1)]  # the others, by their room
    for s in range(len(room)):
        if free[s] < size:
            small[free[s]].append(s)
    some = [(0.0, s) for s in range(len(room))]  # all; an entry counts while its cost does and there is room
    turn = size
    while wait and some:
        n, d, at = heapq.heappop(wait)
        n = -n
        while turn > n:
            turn -= 1
            for s in small[turn]:
                heapq.heappush(open_, (costs[first + s], s))
            small[turn] = []
        while open_ and (open_[0][0] != costs[first + open_[0][1]] or free[open_[0][1]] < n):
            c, s = heapq.heappop(open_)
            if c == costs[first + s] and free[s]:
                small[free[s]].append(s)
        if open_:
            s = heapq.heappop(open_)[1]
        else:
            while some and (some[0][0] != costs[first + some[0][1]] or not free[some[0][1]]):
                heapq.heappop(some)
            if not some:
                heapq.heappush(wait, (-n, d, at))
                break
            s = some[0][1]
            small[free[s]].remove(s)
        k = min(n, free[s])
        pieces.append((d, at, k, first + s, room[s] - free[s]))
        costs[first + s] += cost(k)
        free[s] -= k
        if free[s]:
            heapq.heappush(some, (costs[first + s], s))
            if free[s] >= turn:
                heapq.heappush(open_, (costs[first + s], s))
            else:
                small[free[s]].append(s)
        if n > k:
            heapq.heappush(wait, (k - n, d, at + k))
    return pieces, costs, sorted((d, at, -n) for n, d, at in wait)


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text).

    A null text counts as empty: its document is the end id alone. Repeated rows
    are packed each by itself. A null doc_id stays null. A very long text is cut into
    full sequences. Other columns, whatever their names, are not read. An empty table
    gives no rows. with_ids adds the piece's ids as a list.
    """
    path = tokenizer or tokenizer_path(WORD_BPE)
    common.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << TASK_BITS
        enc = encoder(path, True)
        # Documents or what is left of them: ids one after another, and for each its doc_id, start, length and all its tokens.
        over = (np.empty(0, "<u4"), pa.array([], pa.int64()), *[np.empty(0, np.int64)] * 3)

        def packed(units, last):
            nonlocal next_id, over
            ids, doc, begin, length, tokens = units
            pieces, costs, left = assign(length.tolist(), max_tokens, last)
            at = np.cumsum(length) - length
            p, r = np.array(pieces, np.int64).reshape(-1, 5), np.array(left, np.int64).reshape(-1, 3)
            over = (
                np.concatenate([ids[at[d] + a : at[d] + a + n] for d, a, n in left]) if left else ids[:0],
                doc.take(pa.array(r[:, 0])), begin[r[:, 0]] + r[:, 1], r[:, 2], tokens[r[:, 0]],
            )
            first = at[p[:, 0]] + p[:, 1]
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(view[4 * b : 4 * (b + k)]) for b, k in zip(first.tolist(), p[:, 2].tolist())]
            columns = [
                doc.take(pa.array(p[:, 0])), pa.array(begin[p[:, 0]] + p[:, 1]), pa.array(p[:, 2]), pa.array(crc, pa.int64()),
                pa.array(tokens[p[:, 0]]), pa.array(next_id + p[:, 3]), pa.array(p[:, 4]), pa.array(np.array(costs)[p[:, 3]], pa.float64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"]
            if with_ids:
                columns.append(pa.array([ids[b : b + k].astype(np.int32) for b, k in zip(first.tolist(), p[:, 2].tolist())], pa.list_(pa.int32())))
                names.append("ids")
            next_id += len(costs)
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in common.sized(batches, "text"):
            raw, counts = enc.encode(batch.column("text"))
            ids = np.insert(raw, np.cumsum(counts), np.uint32(end_id)).astype("<u4", copy=False)
            n = counts + 1
            new = (ids, batch.column("doc_id").cast(pa.int64()), np.zeros(len(n), np.int64), n, n)
            yield packed(tuple(pa.concat_arrays([a, b]) if isinstance(a, pa.Array) else np.concatenate([a, b]) for a, b in zip(over, new)), False)
        yield packed(over, True)

    return common.texts(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
