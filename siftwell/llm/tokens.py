"""Texts to token ids, a block of texts at a time."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Text bytes encoded at a time; entries of a worker's cache of runs, and ids in it.
BLOCK_BYTES, CACHE_ROWS, CACHE_IDS = 1 << 20, 300_000, 3 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cuts() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, whether a text may be cut between bytes of two classes, at 6 x the first + the second)."""
    kind = np.zeros(256, np.uint8)  # 0: never cut here: beyond ASCII, control signs, and the bar, which special tokens hold
    kind[0x21:0x7F] = 3
    for c, signs in ((1, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (4, "'"), (5, " \n"), (0, "|")):
        kind[np.frombuffer(signs.encode(), np.uint8)] = c
    may = np.zeros((6, 6), bool)
    may[5], may[:, 5] = True, True
    for first, second in ((1, (2, 3, 4)), (2, (1, 2, 3, 4)), (3, (1, 2)), (4, (2,))):  # an apostrophe goes with the letters after it
        may[first, list(second)] = True
    return kind, may.ravel()


_KIND, _MAY_CUT = _cuts()


class Encoder:
    """Blocks of texts to the ids of all of them.

    This kind of tokenizer lower-cases, drops white space and joins no letters with digits or signs, so a text's ids are those of its
    runs of ASCII letters, digits and signs; what else there is stays in one piece with its neighbours. Runs are slices of the texts'
    own buffer; Arrow finds the different ones, each is tokenized once and kept, and one gather writes the ids of the block.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tok, self.end_id = Tokenizer.from_file(path), end_id
        self.width = 2 if max(self.tok.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.lengths, self.starts = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.used = 0

    @staticmethod
    def _grown(held: np.ndarray, used: int, more: int) -> np.ndarray:
        return held if used + more <= len(held) else np.concatenate([held, np.zeros(max(len(held), more), held.dtype)])

    def _slots(self, runs: list[str]) -> np.ndarray:
        """Where each run's ids stand."""
        if len(self.slots) > CACHE_ROWS or self.used > CACHE_IDS:
            self._forget()
        if new := [r for r in runs if r not in self.slots]:
            letters = [r.isalpha() and r.isascii() and r.islower() for r in new]  # one word, which needs no normalising
            other = iter(self.tok.encode_batch_fast([r for r, plain in zip(new, letters, strict=True) if not plain], add_special_tokens=False))
            of = self.tok.model.tokenize
            ids = [[t.id for t in of(r)] if plain else next(other).ids for r, plain in zip(new, letters, strict=True)]
            n, lengths = len(self.slots), np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(lengths.sum())
            self.starts, self.lengths, self.ids = self._grown(self.starts, n, len(new)), self._grown(self.lengths, n, len(new)), self._grown(self.ids, self.used, total)
            self.starts[n : n + len(new)], self.lengths[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths, lengths
            self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
            self.slots.update(zip(new, range(n, n + len(new)), strict=True))
            self.used += total
        return np.fromiter(map(self.slots.__getitem__, runs), np.int32, len(runs))

    @staticmethod
    def _lowered(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """data with ASCII letters in lower case, but for those that a mark may follow and the runs that may be special tokens."""
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[:-1] &= data[1:] < 0x80
        out = np.where(upper, data | 0x20, data)
        for run in np.unique(np.searchsorted(edges, np.flatnonzero(data == 0x7C), "right") - 1):
            a, b = edges[run], edges[run + 1] if run + 1 < len(edges) else len(data)
            out[a:b] = data[a:b]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by end_id; where each text's begin, and the end). texts: strings, none null."""
        _, offsets, values = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        lo, hi = at[:-1] - at[0], at[1:] - at[0]
        data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        kind = _KIND[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = _MAY_CUT[kind[:-1] * 6 + kind[1:]]
        begins[lo[lo < hi]] = True
        edges = np.flatnonzero(begins).astype(np.int32)
        del kind, begins
        if len(edges):
            cuts = np.append(edges, np.int32(len(data)))
            runs = pa.Array.from_buffers(pa.string(), len(edges), [None, pa.py_buffer(cuts), pa.py_buffer(self._lowered(data, edges))]).dictionary_encode()
            slot = self._slots(runs.dictionary.to_numpy(zero_copy_only=False).tolist())[runs.indices.to_numpy()]
        else:
            slot = np.zeros(0, np.int32)
        n = self.lengths[slot]
        upto = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=upto[1:])
        text_upto = upto[np.searchsorted(edges, hi)]
        # an id of run r stands as far behind the run's first as its place in the block behind the run's place there
        ids = self.ids[np.repeat(self.starts[slot] - upto[:-1], n) + np.arange(upto[-1], dtype=np.int32)]
        return np.insert(ids, text_upto, self.end_id), np.append(0, text_upto + np.arange(1, len(texts) + 1))


@cache
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The process's encoder: a worker's later tasks know the runs of its earlier ones."""
    return Encoder(path, end_id)


def blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about BLOCK_BYTES with the row they begin at; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)
