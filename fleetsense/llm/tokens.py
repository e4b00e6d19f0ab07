"""Token ids of whole texts by public tokenizers, with a bounded cache of word encodings.

Both vocabularies split a text into words before their merges, and no merge
crosses a word's border, so the ids of a text are the ids of its words in order.
Words repeat, so each worker encodes a word once and keeps its ids. The cuts are
single spaces; words go to the library as words, and it reports which word each
id belongs to, so a word's ids never depend on what else is encoded with it. A text
with a space next to other white space goes through the tokenizer whole where
such runs matter.
"""

from __future__ import annotations

import itertools
import os
import sys
import types

import numpy as np

#: Words that a worker keeps; others are encoded again.
CACHE_WORDS = 600_000
#: Words longer than this are not kept, so that the cache's size stays bounded.
CACHE_CHARS = 100
#: Words that the library encodes in one call.
CALL_WORDS = 1000
#: A space in a run of white space (a superset of what the tokenizers take for it).
RUN = r"[\s\x0b\x1c-\x1f\x85\pZ] | [\s\x0b\x1c-\x1f\x85\pZ]"
#: A word that is empty or has such white space at an end.
ODD_WORD = r"^$|^[\s\x0b\x1c-\x1f\x85\pZ]|[\s\x0b\x1c-\x1f\x85\pZ]$"

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


class Encoder:
    """encode(texts) gives all ids and the number of ids of each text.

    drops_spaces: the tokenizer removes white space (word_bpe_49k.json); else a
    space belongs to the word after it (byte_bpe_50k.json).
    """

    def __init__(self, path: str, drops_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_spaces = drops_spaces
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        if not drops_spaces:
            self.id_bytes[list(vocabulary.values())] = [len(name) for name in vocabulary]
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.starts = np.empty(CACHE_WORDS, np.int64)
        self.sizes = np.empty(CACHE_WORDS, np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), np.array([len(x) for x in ids], np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same, of all words as one text, which is cheaper: an id of the byte vocabulary stands for as many bytes as its name has letters.

        None where a word begins or ends with white space, so that the cuts might depend on its neighbours, or where words do not end with an id.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        text = " ".join(["", *words])
        if self.drops_spaces or pc.match_substring_regex(pa.array([text + " "], pa.large_string()), RUN)[0].as_py():
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(np.asarray(pc.binary_length(pa.array(words, pa.large_string()))) + 1)
        upto = np.cumsum(self.id_bytes[ids])
        last = np.searchsorted(upto, ends)
        if not len(ids) or upto[-1] != ends[-1] or (upto[last] != ends).any():
            return None
        return ids.astype(np.uint32), np.diff(last, prepend=-1)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words; the library itself says which word an id is of, or the bytes that its ids stand for do."""
        out, counts = [], []
        for at in range(0, len(words), CALL_WORDS):
            part = words[at : at + CALL_WORDS]
            if (joined := self._joined(part)) is not None:
                out.append(joined[0])
                counts.append(joined[1])
                continue
            found = self.tokenizer.encode(part if self.drops_spaces else [" " + w for w in part], is_pretokenized=True, add_special_tokens=False)
            out.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return (np.concatenate(out), np.concatenate(counts)) if out else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and each text's number of ids (int64), of a list of texts or an Arrow array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.drops_spaces or not len(column):
            return self._by_words(column)
        runs = pc.match_substring_regex(column, RUN)
        whole = np.asarray(runs)
        if whole.all():
            return self._plain(column.to_pylist())
        if not whole.any():
            return self._by_words(column)
        parts = [self._by_words(column.filter(pc.invert(runs))), self._plain(column.filter(runs).to_pylist())]
        sizes = np.empty(len(column), np.int64)
        sizes[~whole], sizes[whole] = parts[0][1], parts[1][1]
        of = np.repeat(whole, sizes)
        ids = np.empty(len(of), np.uint32)
        ids[~of], ids[of] = parts[0][0], parts[1][0]
        return ids, sizes

    def _append(self, ids: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(need, len(self.flat)), np.uint32)])
        self.flat[self.used : need] = ids
        self.used = need

    def _by_words(self, column) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.drops_spaces:
            column = pc.replace_substring(column, "\n", " ")
        parts = pc.split_pattern(column, " ")
        n_words = np.diff(np.asarray(parts.offsets)).astype(np.int64)
        values = parts.flatten()
        coded = pc.dictionary_encode(values.cast(pa.string()) if values.nbytes < 1 << 31 else values)  # short offsets are hashed faster
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        code = np.array(coded.indices)
        slot = np.fromiter(map(self.index.get, names.tolist(), itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        kept_used = self.used
        starts, sizes = self.starts[slot], self.sizes[slot]
        if len(new):
            found = coded.dictionary.take(pa.array(new))
            keep = np.asarray(pc.utf8_length(found)) <= CACHE_CHARS
            if len(self.index) + keep.sum() > CACHE_WORDS:  # too many: those that the batch has twice, as many as fit
                keep &= np.bincount(code, minlength=len(names))[new] > 1
                keep[np.flatnonzero(keep)[CACHE_WORDS - len(self.index) :]] = False
            # What is kept comes first, so that the rest can be overwritten; in both, words that cannot be joined come last.
            odd = np.zeros(len(new), bool) if self.drops_spaces else np.asarray(pc.match_substring_regex(found, ODD_WORD))
            new = new[np.lexsort([odd, ~keep])]
            words, k, n = names[new].tolist(), int(keep.sum()), len(self.index)
            ids, counts = self._words(words)
            starts[new] = self.used + np.cumsum(counts) - counts
            sizes[new] = counts
            kept_used = self.used + int(counts[:k].sum())
            self._append(ids)
            self.starts[n : n + k], self.sizes[n : n + k] = starts[new[:k]], counts[:k]
            self.index.update(zip(words[:k], range(n, n + k)))
        if not self.drops_spaces:  # the first word has no space before it; an empty one is no word
            at = np.cumsum(n_words) - n_words
            firsts = pc.dictionary_encode(values.take(pa.array(at)))
            first_ids, first_sizes = self._plain(firsts.dictionary.to_pylist())
            code[at] = len(names) + np.asarray(firsts.indices)
            starts = np.concatenate([starts, self.used + np.cumsum(first_sizes) - first_sizes])
            sizes = np.concatenate([sizes, first_sizes])
            self._append(first_ids)
        # The ids of each distinct word are the bytes of a value, and Arrow copies a value for each word of the texts.
        ends = np.cumsum(sizes)
        pos = np.arange(int(ends[-1]) if len(ends) else 0)
        pos += np.repeat(starts - (ends - sizes), sizes)
        self.used = kept_used
        of_names = [None, pa.py_buffer(4 * np.concatenate([[0], ends])), pa.py_buffer(self.flat.take(pos))]
        _, upto, ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), of_names).take(pa.array(code)).buffers()
        upto = np.frombuffer(upto, np.int64)[: len(code) + 1] // 4
        bounds = upto[np.concatenate([[0], np.cumsum(n_words)])]
        return np.frombuffer(ids, np.uint32)[: int(upto[-1])], np.diff(bounds)


def encoder(path: str, drops_spaces: bool) -> Encoder:
    """The worker's own encoder: it and its cache outlive a task."""
    kept = sys.modules.setdefault("_fleetsense_kept", types.ModuleType("_fleetsense_kept")).__dict__
    key = ("encoder", path)
    if key not in kept:
        kept[key] = Encoder(path, drops_spaces)
    return kept[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
