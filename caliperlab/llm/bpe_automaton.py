"""BPE as a deterministic automaton over tokens, compiled merge by merge.

States read token labels. Before any merge one state loops on every base symbol. The gadget of a merge
(u, v) -> w splits the state that u leads to, takes v from the copy, and adds w wherever u could be read
before, to the state that v leads to. A path of the finished automaton is a correct tokenization, and
each string has exactly one. All arcs of a token lead to one state, so a state is kept as what it lost:
token -> rank of the merge that took it. Whether a state has an arc follows from the token's leftmost
chain of parts, and is tabulated when first asked for.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NEVER = 1 << 60
#: Pieces, words and arcs kept for reuse in a worker; those longer than KEPT_LENGTH are computed each time.
KEPT, KEPT_LENGTH = 300_000, 48


#: Marks that end a word; letters from this code point on are split by the library alone.
MARKS, LETTERS_BELOW = ",.", "\u0500"
#: The symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SYMBOLS = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SELF))}


class Automaton:
    @classmethod
    def of(cls, path: str, kept: int = KEPT) -> Automaton:
        loaded = common.worker_memory("bpe")
        if path not in loaded:
            loaded[path] = cls(path)
        loaded[path].kept = kept
        return loaded[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if library.decoder is not None:
            raise ValueError(f"{path} names a decoder; labels of this automaton's arcs are joined by spaces")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.pre_split = library.pre_tokenizer.pre_tokenize_str
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.id_of: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.label = {i: s for s, i in (self.id_of | added).items()}
        # every ending of a token's label: the token, or -1 where the ending is none
        self.endings: dict[str, int] = {}
        for x in self.id_of:
            for k in range(max(1, len(x) - len(self.end)) if self.end and x.endswith(self.end) else len(x)):
                self.endings.setdefault(x[k:], -1)
        self.endings |= self.id_of
        self._compile([m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]])
        self.kept = KEPT
        self.cut, self.marks = self._cuts_hold(), False
        self.marks = self._marks_hold()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, bytes, str]] = {}
        self.before: dict[str, tuple[int, bytes, str]] = {}

    def _compile(self, merges: list[list[str]]) -> None:
        self.head: dict[int, tuple[int, int]] = {}  # token -> its left part, rank of its merge
        self.state = dict.fromkeys(self.id_of.values(), 0)  # token -> the state that its arcs lead to
        self.lost: list[dict[int, int]] = [{}]
        shared = [len(self.state)]
        for rank, (a, b) in enumerate(merges):
            u, v, w = self.id_of[a], self.id_of[b], self.id_of[a + b]
            s, after = self.state[u], self.state[v]
            shared[self.state[w]] -= 1
            if shared[s] > 1 or u == v:
                shared[s] -= 1
                self.state[u] = len(self.lost)
                self.lost.append(dict(self.lost[s]))
                shared.append(1)
            self.lost[self.state[u]][v] = rank
            self.head[w] = (u, rank)
            self.state[w] = after
            shared[after] += 1
        self.arcs: dict[int, bool] = {}

    def has_arc(self, state: int, token: int) -> bool:
        key = state * len(self.label) + token
        if (known := self.arcs.get(key)) is not None:
            return known
        lost, ok, t = self.lost[state], token not in self.lost[state], token
        while ok and t in self.head:
            t, rank = self.head[t]
            ok = lost.get(t, NEVER) > rank
        if len(self.arcs) >= self.kept:
            self.arcs.clear()
        self.arcs[key] = ok
        return ok

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The token path that spells a pre-split word; symbols that the vocabulary lacks are left out."""
        if (known := self.words.get(word)) is not None:
            return known
        n, ids = len(word), self.id_of
        symbols = [c for c in word[:-1] if c in ids] + [c for c in word[-1:] if c + self.end in ids]
        if len(symbols) < n:
            word, n = "".join(symbols), len(symbols)
        states, back = [0] + [-1] * n, [(0, 0)] * (n + 1)
        arcs, span, endings = self.arcs, len(self.label), self.endings
        for i in range(1, n + 1):
            end = self.end if i == n else ""
            able = []
            for j in range(i - 1, -1, -1):
                token = endings.get(word[j:i] + end if end else word[j:i])
                if token is None:
                    break  # no token ends like that, so none with more before it
                if token >= 0 and states[j] >= 0:
                    able.append((j, token))
            for j, token in reversed(able):  # one of them has an arc, mostly the longest
                state = states[j]
                known = arcs.get(state * span + token)
                if self.has_arc(state, token) if known is None else known:
                    states[i], back[i] = self.state[token], (j, token)
                    break
        path, i = [], n
        while i > 0:
            i, token = back[i]
            path.append(token)
        out = tuple(reversed(path))
        if n <= KEPT_LENGTH:
            if len(self.words) >= self.kept * 5 // 6:
                self.words.clear()
            self.words[word] = out
        return out

    def _cuts_hold(self) -> bool:
        """Whether the tokenizer splits a text as it splits its pieces between spaces and line ends, by probes; else texts stay whole."""
        probes = ["a b", "Ab\ncd", " x  y ", "it's 12,5 a.b", "Été, ça\n\nva .", "x  \n y", "don't stop", "1 2"]
        split = lambda x: [w for w, _ in self.pre_split(self.normalize(x))]
        return all(split(p) == [w for piece in p.replace("\n", " ").split(" ") if piece for w in split(piece)] for p in probes)

    def _marks_hold(self) -> bool:
        """Whether `_split` may take letters before a mark itself, by probes."""
        probes = ["word", "Word", "WORD,", "été.", "Straße", "naïve,", "ЖУК", "αβγ.", "x", "ǅ", "ﬁn"]
        slow = [list(self._split(p)) for p in probes]
        self.marks = True
        try:
            return [list(self._split(p)) for p in probes] == slow
        except KeyError:
            return False

    def _split(self, piece: str) -> Iterator[str]:
        """The pre-split words of a piece. Letters before a mark are split here, with the same result."""
        word, mark = (piece[:-1], piece[-1]) if piece[-1:] in MARKS else (piece, "")
        if self.marks and word.isalpha() and max(word) < LETTERS_BELOW:
            plain = word.lower() if word.isascii() else self.normalize(word)
            if plain.isalpha():
                yield plain if plain.isascii() else "".join(map(BYTE_SYMBOLS.__getitem__, plain.encode()))
                if mark:
                    yield mark
                return
        for w, _ in self.pre_split(self.normalize(piece)):
            yield w

    def _piece(self, piece: str) -> tuple[int, bytes, str]:
        ids = [t for w in self._split(piece) for t in self.encode_word(w)] if piece else []
        return len(ids), array("I", ids).tobytes(), " ".join([self.label[t] for t in ids])

    def encode(self, text: str) -> tuple[int, bytes, str]:
        """(number of tokens, ids as little-endian 32-bit integers, decoded text) of a whole text.

        Where the vocabulary's pre-tokenizer drops white space, a text is cut at spaces and line ends first.
        Added tokens are found in the raw text. Decoding emits the labels of the path with a space
        between, as the library does for a vocabulary without decoder.
        """
        if self.added and any(a in text for a in self.added):
            parts = []
            for k, x in enumerate(self.cut_added.split(text)):
                if k % 2:
                    i = self.added[x]
                    parts.append((1, np.asarray([i], "<u4").tobytes(), x))
                elif x:
                    parts.append(self.encode_plain(x))
        else:
            return self.encode_plain(text)
        parts = [p for p in parts if p[0]]
        return sum(p[0] for p in parts), b"".join(p[1] for p in parts), " ".join(p[2] for p in parts)

    def encode_plain(self, text: str) -> tuple[int, bytes, str]:
        known, found = self.pieces, []
        for piece in text.replace("\n", " ").split(" ") if self.cut else (text,):
            got = known.get(piece)
            if got is None:
                got = self.before.get(piece) or self._piece(piece)
                if len(piece) <= KEPT_LENGTH:
                    if len(known) >= self.kept:
                        # what was not asked for since the last turn goes
                        self.before, self.pieces = known, {}
                        known = self.pieces
                    known[piece] = got
            if got[0]:
                found.append(got)
        ids = b"".join([f[1] for f in found])
        return len(ids) // 4, ids, " ".join([f[2] for f in found])


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs(doc_id, text) with n_tokens, ids (little-endian 32-bit, binary) and decoded text.

    A null or empty text, or one of white space alone, has no ids and decodes to an empty text. Repeated
    rows give a row each; other columns are ignored. Narrow: no shuffle.
    """
    return _mapped(docs, tokenizer_path, "doc_id long, n_tokens long, ids binary, decoded string", lambda n, ids, text: (n, ids, text))


def encode_digests(docs: DataFrame, tokenizer_path: str, kept: int = KEPT) -> DataFrame:
    """As encode_decode, with SHA-256 digests in place of the ids and the decoded text.

    `kept` bounds what a worker keeps of pieces (twice that), words and arcs; results don't depend on it.
    """
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, tokenizer_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, text: (n, sha(ids), sha(text.encode())), kept)


def _mapped(docs: DataFrame, path: str, schema: str, made, kept: int = KEPT) -> DataFrame:
    common.ensure_workers(docs.sparkSession)
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(path, kept)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                # many small tuples and no cycles are made here: a search for cycles among them would take a good share of the time
                gc.disable()
                try:
                    rows = [(d, *made(*automaton.encode(t or ""))) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
