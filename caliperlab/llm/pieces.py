"""Whole-text encoding with the tokenizers library, which sees each new piece between spaces once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_memory

_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces longer than that are encoded each time; the rest are kept until there are so many.
KEPT_LENGTH, KEPT = 48, 1_000_000
#: Texts are encoded in groups of about so many bytes, new pieces in runs of so many.
GROUP, RUN = 6_000_000, 256


def _odd(pieces: pa.StringArray) -> np.ndarray:
    """Which pieces are empty, have white space at an end, or hold a space: no others begin with a token and end before one."""
    size = pc.binary_length(pieces).to_numpy()
    trimmed = pc.binary_length(pc.utf8_trim_whitespace(pieces)).to_numpy()
    return (size == 0) | (trimmed < size) | pc.match_substring(pieces, " ").to_numpy(zero_copy_only=False)


class PieceEncoder:
    """A byte-level BPE of the tokenizers library over pieces cut before single spaces.

    Its pre-tokenizer always starts a token at a space between two characters that are no white space,
    so encoding " piece" by " piece" gives the same ids as the whole text. Texts with other runs of
    white space are cut at such spaces alone; texts that hold an added token go whole to the library.

    The ids of all known pieces lie in one array; a text's ids are gathered from it by the rows of its pieces.
    """

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        loaded = worker_memory("pieces")
        if path not in loaded:
            loaded[path] = cls(path)
        return loaded[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(self.vocab_size, *vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token[0] == "Ġ"]] = True  # how byte-level vocabularies write a space
        self._forget()

    def _forget(self) -> None:
        self.at_start: dict[str, int] = {}
        self.after_space: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.dtype), [len(x) for x in ids]

    def _after_spaces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray | list[int]]:
        """Ids of " word" for words without spaces: many at a time, told apart by the tokens that begin with a space."""
        flat, _ = self._library([" " + " ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)])
        starts = np.flatnonzero(self.spaced[flat])
        if len(starts) != len(words):
            return self._library([" " + w for w in words])
        return flat, np.diff(starts, append=len(flat))

    def _add(self, words: list[str], prefix: str, joined: bool) -> np.ndarray:
        """Encode words at the end of the table; their rows."""
        at = len(self.begin) + np.arange(len(words))
        if words:
            flat, size = self._after_spaces(words) if joined else self._library([prefix + w for w in words])
            size = np.asarray(size, np.int64)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return at

    def _known(self, known: dict[str, int], words: list[str], lasting: np.ndarray, prefix: str) -> np.ndarray:
        """Rows of words; new ones that may be kept are, other new ones have -1."""
        rows = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        keep = np.flatnonzero((rows < 0) & lasting)
        new = [words[i] for i in keep.tolist()]
        rows[keep] = at = self._add(new, prefix, bool(prefix))
        known.update(zip(new, at.tolist(), strict=True))
        return rows

    def _rare(self, rows: np.ndarray, words: list[str], prefix: str) -> None:
        missing = np.flatnonzero(rows < 0)
        rows[missing] = self._add([words[i] for i in missing.tolist()], prefix, False)

    def _encode(self, pieces: pa.StringArray, counts: np.ndarray, cut_again: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which texts can be encoded by these pieces, and the ids of each that can.

        Text i is the next counts[i] pieces, one at least. Those with an odd piece must be cut again first.
        """
        coded = pieces.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        fits, odd = np.ones(len(counts), bool), _odd(words)
        if not cut_again and odd.any():
            fits = ~np.logical_or.reduceat(odd[index], np.cumsum(counts) - counts)
            index, counts = index[np.repeat(fits, counts)], counts[fits]
        if not len(counts):
            return fits, []
        if len(self.begin) > KEPT:
            self._forget()
        heads = np.cumsum(counts) - counts
        later = np.ones(len(index), bool)
        later[heads] = False
        lasting = ~odd & (pc.utf8_length(words).to_numpy() <= KEPT_LENGTH)
        rows, parts = np.zeros(len(index), np.int64), []
        for known, prefix, where in ((self.at_start, "", ~later), (self.after_space, " ", later)):
            used = np.zeros(len(words), bool)
            used[index[where]] = True
            own = words.filter(pa.array(used)).to_pylist()
            parts.append((self._known(known, own, lasting[used], prefix), own, prefix, where, np.cumsum(used) - 1))
        n_rows, n_ids = len(self.begin), len(self.flat)
        for found, own, prefix, where, place in parts:
            self._rare(found, own, prefix)
            if len(found):
                rows[where] = found[place[index[where]]]
        size = self.size[rows]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[rows] - ends + size, size) + np.arange(ends[-1])]
        self.flat, self.begin, self.size = self.flat[:n_ids], self.begin[:n_rows], self.size[:n_rows]
        return fits, np.split(ids, np.add.reduceat(size, heads).cumsum()[:-1])

    def encode_all(self, texts: pa.StringArray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(index of the first text, ids of each) for groups of texts; a null text is an empty one."""
        texts = pc.fill_null(texts, "")
        ends, lo = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GROUP, "right")))
            yield lo, self._group(texts.slice(lo, hi - lo))
            lo = hi

    def _group(self, texts: pa.StringArray) -> list[np.ndarray]:
        out: list = [None] * len(texts)

        def put(at: np.ndarray, ids: list[np.ndarray]) -> None:
            for i, x in zip(at.tolist(), ids, strict=True):
                out[i] = x

        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole)
        put(at, [self._library([texts[i].as_py()])[0] for i in at.tolist()])
        at = np.flatnonzero(~whole)
        cut = pc.split_pattern(texts.take(pa.array(at)), " ")
        fits, ids = self._encode(cut.flatten(), pc.list_value_length(cut).to_numpy().astype(np.int64), False)
        put(at[fits], ids)
        at = at[~fits]
        if len(at):
            again = [_SINGLE.split(texts[i].as_py()) for i in at.tolist()]
            _, ids = self._encode(pa.array(chain.from_iterable(again), pa.string()), np.array([len(x) for x in again]), True)
            put(at, ids)
        return out
