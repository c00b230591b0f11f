"""Token ids of a byte-level BPE vocabulary file, exactly as the ``tokenizers`` library gives them.

The library's own encoder takes about 1 MB/s of such texts on a core, and most words occur many times.
The vocabulary's pattern never lets a token reach back over white space. So the words of a batch of texts
are looked up in Arrow's hash table of those met before, new words run through the same file's merges together
(in these files an id is its merge rank, which ``tiktoken`` takes), and the texts' ids are gathered with
numpy from the words' ids. Texts with other white space than single spaces and newlines are encoded whole;
texts with a special token's string or odd control characters, and files of another kind, go to the
library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters on whose being white space libraries differ.
ODD = "\x1c\x1d\x1e\x1f\x85᠎​﻿"
#: White space that is not one space or one newline between visible characters.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
OTHER_SPACE = regex.compile(r"[^\S \n]")


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, the rest follow 255."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _type(library: Tokenizer) -> np.dtype:
    return np.dtype("<u2" if library.get_vocab_size() <= 1 << 16 else "<u4")


class Encoder:
    """``encode_all(texts)`` gives an array of ids for each; unsigned, of 16 bits if the vocabulary allows it."""

    def __init__(self, path: str, cached: int = 250_000):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.odd = [*special, *ODD]
        self.dtype = _type(self.library)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.core, self.cached = None, cached
        if plain and spec["model"]["type"] == "BPE":
            import public_tokenizers

            back = _alphabet()
            ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.newline = self.core.encode_ordinary("\n")[0]
        self.forget()

    def forget(self) -> None:
        """Empty the cache, as at the end of a task: idle workers should hold no memory."""
        self.known = pa.array([], pa.large_string())  # words met so far; a word's place is its number
        self.flat, self.start, self.length = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        even = []
        for k, t in enumerate(texts):
            if not t:
                out[k] = np.zeros(0, self.dtype)
            elif self.core is None or any(s in t for s in self.odd):
                out[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=self.dtype)
            elif t[0] in " \n" or t[-1] in " \n" or any(s in t for s in UNEVEN) or not t.isascii() and OTHER_SPACE.search(t):
                out[k] = np.array(self.core.encode_ordinary(t), dtype=self.dtype)
            else:
                even.append(k)
        for k, ids in zip(even, self._even([texts[k] for k in even])):
            out[k] = ids
        return out

    def _even(self, texts: list[str]) -> list[np.ndarray]:
        """A word that starts a line is "\\n" and the word, the first of a text too; other words follow a space."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        words, bounds = lists.flatten(), lists.offsets.to_numpy()
        if len(self.known) > self.cached:
            self.forget()
        found = pc.index_in(words, value_set=self.known)
        if found.null_count:  # only words not met before become Python strings
            before, unknown = len(self.known), found.is_null()
            self._learn(words.filter(unknown).unique().to_pylist())
            at = found.fill_null(0).to_numpy().astype(np.int64)
            at[unknown.to_numpy(zero_copy_only=False)] = before + pc.index_in(words.filter(unknown), value_set=self.known.slice(before)).to_numpy()
        else:
            at = found.to_numpy().astype(np.int64)
        size = self.length[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])]
        edges = np.concatenate([[0], ends])[bounds]
        return [ids[a + 1 : b] for a, b in zip(edges[:-1], edges[1:])]  # without the newline put before each text

    def _learn(self, new: list[str]) -> None:
        for starts_line in (False, True):
            own = [w for w in new if (w[0] == "\n") == starts_line]
            if not own:
                continue
            # newlines between the words are tokens of their own; here none is part of a word
            text = "".join(own)[1:] if starts_line else "\n".join([" " + w for w in own])
            ids = np.array(self.core.encode_ordinary(text), dtype=self.dtype)
            cut = np.flatnonzero(ids == self.newline)
            first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(ids)]])
            if starts_line:  # each keeps the newline before it
                ids, first, last = np.concatenate([[self.newline], ids]).astype(self.dtype), first, last + 1
            base = len(self.flat)
            self.known = pa.concat_arrays([self.known, pa.array(own, pa.large_string())])
            self.flat = np.concatenate([self.flat, ids])
            self.start = np.concatenate([self.start, first + base])
            self.length = np.concatenate([self.length, last - first])


@lru_cache(maxsize=4)
def id_type(path: str) -> np.dtype:
    """The type of an encoder's ids, without the encoder's tables: the driver needs no more."""
    return _type(Tokenizer.from_file(path))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
