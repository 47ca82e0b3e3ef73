"""Token ids of whole texts by a public tokenizer, with a word cache.

The tokenizer's normaliser and splitter never join anything across ASCII white space, so a text's ids are the ids of
its white-space-separated words in order.  Each distinct word is encoded by the library once while it stays in the
worker's bounded cache.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loglattice.llm._words import SPACE, blocks, trim, word_hashes, word_spans

CACHE_WORDS = 600_000  # words a worker keeps, about 35 MB, and half as many parts of unseen words, about 70 MB
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?*#%$&]*)\n|([^\n]+)\n")
_workers: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts.  Equal words of a block are found byte by byte; the cache is searched by hash and a word taken
    from it only if its bytes are equal, so no two words are ever mistaken and a known one is no Python object."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)  # ids that only end a word
        if mark:
            self.last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(mark)]] = True
        self.parts: dict[str, bytes] = {}
        self.words = pa.array([], pa.large_binary())
        self.keys = np.zeros(0, np.uint64)  # sorted hashes, which of words each is, where in flat its ids begin and how many they are
        self.place, self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """As _encode, for strings that are one word to the tokenizer each: many in one call, told apart by the
        ids that end a word, or by word number where a tokenizer has none."""
        out: list[bytes] = []
        for at in range(0, len(parts), 2_000):
            some = parts[at : at + 2_000]
            if self.last.any():
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
                cuts = np.flatnonzero(self.last[ids[:-1]]) + 1
            else:
                found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                ids = np.array(found.ids, self.dtype)
                cuts = np.flatnonzero(np.diff(np.array(found.word_ids, np.int64))) + 1
            if len(cuts) + 1 != len(some):  # a tokenizer that splits them otherwise
                out += self._encode(some)
                continue
            body = ids.tobytes()
            ends = [*(cuts * self.dtype.itemsize).tolist(), len(body)]
            out += [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words; a plain Latin word with plain punctuation behind is its letters' ids and the punctuation's."""
        parts = self.parts
        if len(parts) > CACHE_WORDS // 2:
            for part in list(islice(parts, len(parts) // 2)):  # the older half
                del parts[part]
        split = _PLAIN.findall(b"\n".join([*words, b""]).decode().lower())
        need = list({part for stem, tail, _ in split for part in (stem, tail)}.difference(parts, ("",)))
        parts.update(zip(need, self._encode_parts(need), strict=True))
        parts[""] = b""
        out = [parts[stem] + parts[tail] for stem, tail, _ in split]
        if whole := [k for k, (_, _, other) in enumerate(split) if other]:
            for k, found in zip(whole, self._encode([words[k].decode() for k in whole]), strict=True):
                out[k] = found
        return out

    def rows(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin, with the total at the end)."""
        starts, ends = word_spans(offsets, data)
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        size = np.cumsum(ends - starts)
        body = data[~SPACE[data]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, size)), pa.py_buffer(body)]).dictionary_encode()
        distinct, which = words.dictionary, words.indices.to_numpy()
        _, edges, letters = next(blocks(distinct, 1 << 62))
        hashes, _ = word_hashes(edges, letters)
        begin, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            at = np.searchsorted(self.keys, hashes)
            at[at == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[at] == hashes)
            same = pc.equal(distinct.take(pa.array(hit)), self.words.take(pa.array(self.place[at[hit]]))).to_numpy(zero_copy_only=False)
            known[hit[same]] = True
            begin[known], count[known] = self.begin[at[known]], self.count[at[known]]
        flat, used = self.flat, self.used
        missing = np.flatnonzero(~known)
        if len(missing):
            unseen = distinct.take(pa.array(missing))
            learnt = self._learn(unseen.to_pylist())
            sizes = np.array([len(x) for x in learnt], np.int64) // self.dtype.itemsize
            ids = np.frombuffer(b"".join(learnt), self.dtype)
            begin[missing], count[missing] = used + np.cumsum(sizes) - sizes, sizes
            if used + len(ids) > len(flat):
                flat = np.concatenate([flat[:used], np.zeros(used + 2 * len(ids) + (1 << 16), self.dtype)])
            flat[used : used + len(ids)] = ids
            if len(self.keys) + len(missing) <= CACHE_WORDS:  # once full the first words stay, which are the frequent ones
                order = np.argsort(hashes[missing], kind="stable")
                at, own = np.searchsorted(self.keys, hashes[missing][order]), missing[order]
                self.place = np.insert(self.place, at, len(self.words) + order)
                self.keys = np.insert(self.keys, at, hashes[own])
                self.begin, self.count = np.insert(self.begin, at, begin[own]), np.insert(self.count, at, count[own])
                self.words = pa.concat_arrays([self.words, unseen])
                self.flat, self.used = flat, used + len(ids)
        sizes = count[which]
        stops = np.cumsum(sizes)
        take = np.repeat(begin[which] - stops + sizes, sizes) + np.arange(int(stops[-1]))
        return flat[take], np.append(0, stops)[first]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; Spark reuses workers, so it outlives a task."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def forget() -> None:
    """Give back what encoders keep in this worker, which outlives the stages that read them; the next use builds one anew."""
    if _workers:
        _workers.clear()
        trim()


def token_batches(path: str, ids: pa.Array, texts: pa.Array, most: int = 2 << 20):
    """(doc ids, ids of each text as an integer array) for consecutive rows of about ``most`` bytes; null text: empty."""
    own = encoder(path)
    values = ids.to_pylist()
    for at, offsets, data in blocks(texts, most):
        flat, first = own.rows(offsets, data)
        yield values[at : at + len(offsets) - 1], np.split(flat, first[1:-1])
