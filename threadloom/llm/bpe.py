"""Byte-level BPE over whole corpora: merge rounds over many words at once in numpy.

The distinct words of a batch lie one after another in a flat array of symbols. In each round the neighbouring pairs are
looked up by binary search among the sorted pair keys of the merge table, every word merges all occurrences of its
lowest-ranked pair, and words without a known pair leave. A word is merged once per worker and then looked up, in a
table whose size is bounded.

Defined results: a null or empty text has no tokens; a blank text is encoded as it is; strings of special tokens are
ordinary text. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker keeps merged, at most; beyond that it starts afresh.
KEPT_WORDS = 300_000
_NO_RANK = np.iinfo(np.int64).max
#: How the public byte-level vocabularies split a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable bytes as themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(plain))
    return letters


@dataclass
class Vocabulary:
    """Ids of the single bytes, and the merges: sorted pair keys with their ranks and the ids that they make."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    width: int
    kept: dict[str, int] = field(default_factory=dict)
    kept_ids: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        letters = byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        width = max(ids.values()) + 1
        keys = np.array([ids[a] * width + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        return cls(np.array([ids[letters[b]] for b in range(256)], np.int64), keys[order], order.astype(np.int64), made[order], width)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of all words one after another, and how many each word has."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            inner = word[1:] == word[:-1]
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = inner & (self.keys[at] == key)
            rank = np.append(np.where(known, self.ranks[at], _NO_RANK), _NO_RANK)
            first = np.append(0, np.flatnonzero(~inner) + 1)
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            stuck = np.repeat(low == _NO_RANK, length)
            if stuck.any():
                done_sym.append(sym[stuck])
                done_word.append(word[stuck])
                live = ~stuck
                sym, word, rank = sym[live], word[live], rank[live]
                low, length = low[low != _NO_RANK], length[low != _NO_RANK]
                at = np.append(at, 0)[live]
                if not len(sym):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == np.repeat(low, length)
            # of overlapping occurrences (aaa) every second one merges, from the left
            where = np.flatnonzero(hit)
            run = np.cumsum(np.append(True, np.diff(where) != 1)) - 1
            start = where[np.append(True, np.diff(where) != 1)]
            where = where[(where - start[run]) % 2 == 0]
            sym[where] = self.made[at[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        ids, owner = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def codes(self, texts: list[list[str]]) -> np.ndarray:
        """A number for each word of all texts, under which ``kept_ids`` has its ids."""
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.kept_ids = {}, []
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.kept))
        if new:
            ids, size = self.merge(new)
            for w, part in zip(new, np.split(ids, np.cumsum(size)[:-1])):
                self.kept[w] = len(self.kept_ids)
                self.kept_ids.append(part)
        kept = self.kept
        return np.array([kept[w] for words in texts for w in words], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of a batch of texts."""
        words = [_FIND(t) if t else [] for t in texts]
        n_words = np.array([len(w) for w in words], np.int64)
        code = self.codes(words)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        used, code = np.unique(code, return_inverse=True)
        parts = [self.kept_ids[u] for u in used]
        size = np.array([len(p) for p in parts], np.int64)
        start, flat = np.cumsum(size) - size, np.concatenate(parts)
        lengths = size[code]
        offset = np.cumsum(lengths) - lengths
        ids = flat[np.arange(int(lengths.sum())) - np.repeat(offset - start[code], lengths)]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(n_words))]
        return ids, np.diff(ends)


_FIND = regex.compile(WORDS).findall
_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker; where a worker has no such file, the copy that the driver shipped is read."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.read(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _LOADED[path]


def _shipped(df: DataFrame, path: str) -> None:
    """Send the file, of some megabytes, to all workers with the session's files, once."""
    context = df.sparkSession.sparkContext
    if os.path.exists(path) and not any(f.endswith(f"/{os.path.basename(path)}") for f in context.listFiles):
        context.addFile(path)


def _pieces(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts in portions of bounded size."""
    values, at, size = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        values.append(t)
        size += len(t or "")
        if size > most:
            yield at, values
            values, at, size = [], i + 1, 0
    if values:
        yield at, values


def token_ids(df: DataFrame, ident: str, text: str, path: str) -> DataFrame:
    """``(ident, ids)``: the token ids of each row's text; no shuffle, and every row of ``df`` comes out, in its order."""

    _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at, values in _pieces(batch.column(1)):
                ids, size = vocab.encode(values)
                offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(values)), lists], names=[ident, "ids"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, ids array<int>")


def token_counts(df: DataFrame, ident: str, text: str, path: str) -> DataFrame:
    """``(ident, n_tokens)`` of each row's text."""

    _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at, values in _pieces(batch.column(1)):
                size = vocab.encode(values)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(values)), pa.array(size.astype(np.int64))], names=[ident, "n_tokens"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident), F.col(text)).mapInArrow(run, f"`{ident}` {kind}, n_tokens long")
