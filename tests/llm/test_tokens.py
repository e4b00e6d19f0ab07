import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetsense.llm import packing, token_files, tokens

from . import helpers as H


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = True
    return t


ENCODERS = {n: (tokens.Encoder(tokens.tokenizer_path(n), d), plain(n)) for n, d in ((tokens.WORD_BPE, True), (tokens.BYTE_BPE, False))}


@pytest.mark.parametrize("name", sorted(ENCODERS))
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("ab ÉéßİΣ'\n\t.!0  ́\x1c|<>😀")) | st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=4))
def test_words_give_the_ids_of_the_text(name, texts):
    enc, t = ENCODERS[name]
    ids, n = enc.encode(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    enc, t = tokens.Encoder(tokens.tokenizer_path(tokens.WORD_BPE), True), ENCODERS[tokens.WORD_BPE][1]
    for k in range(4):
        texts = [H.prose(k, 30), H.prose(k + 9, 5)]
        ids, _ = enc.encode(texts)
        assert ids.tolist() == [i for x in texts for i in t.encode(x, add_special_tokens=False).ids]
        assert len(enc.index) <= 50


ODD_WORDS = ["e\u0301", "\u0130", "x", "\u0130e\u0301", "a\u0301b", "\u1100\u1161", "\u01c4", "\u00df", "don't", "<|endoftext|>"]


@pytest.mark.parametrize("name", sorted(ENCODERS))
def test_ids_do_not_depend_on_what_else_is_encoded(name):
    """Composed, decomposed and dotted letters in every order of two, with a cache warm from all the others."""
    enc, t = tokens.Encoder(tokens.tokenizer_path(name), name == tokens.WORD_BPE), ENCODERS[name][1]
    for a in ODD_WORDS:
        for b in ODD_WORDS:
            for texts in ([f"{a} {b} x"], [b], [f"{b} plain", a], [f"{a}\n \n{b}", f"{a}  {b}"]):
                ids, n = enc.encode(texts)
                want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
                assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want], texts


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(0, 300), max_size=60), size=st.sampled_from([1, 8, 64, 100]), last=st.booleans())
def test_assignment_places_every_token_once(lengths, size, last):
    pieces, costs, left = packing.assign(lengths, size, last)
    seen = {d: np.zeros(n, int) for d, n in enumerate(lengths)}
    used: dict[int, list] = {}
    for d, start, n, s, off in pieces:
        assert n > 0
        seen[d][start : start + n] += 1
        used.setdefault(s, []).append((off, n))
    for d, start, n in left:
        seen[d][start : start + n] += 1
    assert all((x == 1).all() for x in seen.values()) and len(costs) == len(used)
    assert not left if last else sum(n for _, _, n in left) < size
    for s in used.values():  # gapless, and of a length that needs no padding
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at == size or last and at < size and (at & (at - 1) == 0 or size & (size - 1))


def test_assignment_is_the_cheapest_with_room():
    """Against a plain search of all sequences for each document, as long as none must be cut."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 40, 120).tolist()
        pieces, _, _ = packing.assign(lengths, 64, False)
        room, costs = [64] * (sum(lengths) // 64), [0.0] * (sum(lengths) // 64)
        for (d, start, n, s, off), (neg, want) in zip(pieces, sorted((-n, d) for d, n in enumerate(lengths))):
            fits = [(costs[k], k) for k in range(len(room)) if room[k] >= -neg]
            if not fits:
                break
            k = min(fits)[1]
            assert (d, start, n, s, off) == (want, 0, -neg, k, 64 - room[k])
            room[k] -= n
            costs[k] += packing.cost(n)
        else:
            raise AssertionError("the rest must be cut somewhere")


def test_pack(spark):
    df, rows = H.awkward(spark)
    got = packing.pack(df, with_ids=True).collect()
    t = ENCODERS[tokens.WORD_BPE][1]
    want = sorted(((r[0] is None, r[0] or 0), tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    docs = {}
    for p in got:
        assert H.crc(p.ids) == p.ids_crc32 and p.length == len(p.ids)
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, tuple(p.ids)))
    total = sum(len(x) for _, x in want)
    assert sum(p.length for p in got) == total
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    once = {k: v for k, v in docs.items() if k[0] in (1, 6, 9, 10, 14, 15)}
    for (i, n), parts in once.items():
        assert [x for _, ids in sorted(parts) for x in ids] == list(next(x for (_, d), x in want if d == i)) and n == sum(len(x) for _, x in parts)
    assert packing.pack(spark.createDataFrame([], H.SCHEMA)).count() == 0


def test_one_tail_for_each_task(spark, monkeypatch):
    from fleetsense.llm import common

    sized = common.sized
    monkeypatch.setattr(common, "sized", lambda batches, column: sized(batches, column, 20_000))  # many groups in a task
    df = spark.createDataFrame([(i, H.prose(i, 60 + i % 90)) for i in range(400)], "doc_id long, text string").repartition(2)
    got = packing.pack(df).collect()
    lengths = {}
    for p in got:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    assert sum(n < 4096 for n in lengths.values()) <= 2 * 12 and len(lengths) > 20
    whole = {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        assert p.start == whole.get(p.doc_id, 0)
        whole[p.doc_id] = p.start + p.length
    assert all(whole[p.doc_id] == p.doc_tokens for p in got) and len(whole) == 400


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    _, costs, _ = packing.assign(rng.integers(20, 900, 400).tolist(), 4096)
    full = np.array(sorted(costs)[len(costs) // 5 :])
    assert full.std() / full.mean() < 0.1


def test_token_files(spark, tmp_path):
    df, rows = H.awkward(spark)
    token_files.write_tokens(df, str(tmp_path / "t"))
    t = ENCODERS[tokens.BYTE_BPE][1]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(token_files.digest(token_files.read_tokens(spark, str(tmp_path / "t"))).collect(), key=lambda r: r.start)
    at = 0
    for r, g in zip(ordered, got, strict=True):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], at, len(ids), H.crc(ids))
        at += len(ids)
    some = token_files.read_tokens(spark, str(tmp_path / "t"), "doc_id = 6")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)" in some._jdf.queryExecution().executedPlan().toString()
    assert t.decode(some.first().ids[:-1]) == "one two three"
    meta = token_files.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "n_tokens")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    import glob

    import pyarrow.parquet as pq

    f = pq.ParquetFile(sorted(glob.glob(str(tmp_path / "t/ids/*.parquet")))[0]).metadata
    column = f.row_group(0).column(f.num_columns - 1)
    assert column.has_column_index and column.has_offset_index and "RLE_DICTIONARY" in column.encodings


def test_no_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], H.SCHEMA), str(tmp_path / "e"))
    assert token_files.digest(token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_words_in_one_call_are_those_of_words_alone():
    """Ids of joined words against the library's on each word; words with white space at an end are not joined."""
    import random

    from fleetsense.llm import tokens

    r = random.Random(9)
    e = tokens.Encoder(tokens.tokenizer_path(tokens.BYTE_BPE), False)
    signs = [*"abcXYZ019'.,-_/<|>é中́\n\t\U0001f600", "'s", "the", "http://", "ing"]
    words = ["".join(r.choices(signs, k=r.randint(1, 9))) for _ in range(3000)]
    plain = [w for w in words if not (w[0].isspace() or w[-1].isspace())]
    assert e._joined(words) is None and e._joined(["a", ""]) is None
    ids, sizes = e._joined(plain)
    alone = [e.tokenizer.encode(" " + w, add_special_tokens=False).ids for w in plain]
    assert sizes.tolist() == [len(x) for x in alone] and ids.tolist() == [i for x in alone for i in x]


def test_columns_give_the_ids_of_lists_and_odd_words_share_calls(monkeypatch):
    """Arrow columns, whole or sliced; words with white space at an end do not keep the others from one call."""
    import pyarrow as pa

    texts = [*(H.prose(k, 40) + f" w{k}x" + "\n" * (k % 3 == 0) for k in range(300)), "", " a", "b  c", "\n", "é\u2028"]
    for name, (_, t) in ENCODERS.items():
        enc = tokens.Encoder(tokens.tokenizer_path(name), name == tokens.WORD_BPE)
        calls, joined = [], enc._joined
        monkeypatch.setattr(enc, "_joined", lambda words: calls.append(joined(words)) or calls[-1])
        monkeypatch.setattr(tokens, "CALL_WORDS", 20)
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        for column, first in ((pa.array(texts), 0), (pa.array(texts, pa.large_string()).slice(7), 7)):
            ids, n = enc.encode(column)
            assert ids.tolist() == [i for x in want[first:] for i in x] and n.tolist() == [len(x) for x in want[first:]]
        if name == tokens.BYTE_BPE:
            odd = len({w for x in texts for w in x.split(" ") if w != w.strip() or not w})
            assert sum(x is None for x in calls) <= odd // 20 + 2 < len(calls) // 3
