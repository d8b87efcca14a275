"""Near-duplicate texts by Order MinHash, verified by banded alignment and an exact count of shared shingles.

A text is the sequence of its lower-cased words. Its k-mers of words carry the number of their occurrence, so repeats count. For
each of several hash functions the sketch keeps the ``keep`` k-mers of smallest hash in text order; the hash of that tuple is
a band. Texts that share a band are candidates: the tuple agrees only if the same k-mers are the smallest and stand in
the same order, which makes it sensitive to edits. Every fourth band looks at first occurrences only, as two texts that repeat the
same lines a different number of times share few labelled k-mers. The distinct shingles of candidates are counted exactly, and those that
reach the threshold are aligned word by word inside a band around the diagonal of their best offset.

A band of more than ``HOT`` different texts (boilerplate) is not paired. Its texts are joined exactly by prefix filtering:
two of them can only reach the threshold if they share one of the rarest shingles of either, which boilerplate is not.

Defined results: nulls are empty texts; texts with fewer than ``least`` distinct shingles match nothing; texts with the same
words are one class, which takes part once and is joined to its members at the end; rows with a null id are left out; an
id that occurs with several texts matches by any of them, but never itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.arrow import binary, matrix
from threadloom.session import Scratch

#: Words of a k-mer, k-mers of a sketch tuple, tuples of a text.
K, KEEP, BANDS = 3, 3, 48
#: Different texts of a band that are paired with each other.
HOT = 64
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORDS = regex.compile(r"[\p{L}\p{N}]+").findall
_KNOWN: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): 32-bit hashes of the words of all texts, and how many words each has."""
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    known, hashed = _KNOWN, xxhash.xxh32_intdigest
    words = [_WORDS(t.lower()) if t else [] for t in texts]
    for w in {w for ws in words for w in ws if w not in known}:
        known[w] = hashed(w)
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64)
    return flat, np.array([len(w) for w in words], np.int64)


def kmers(words: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place) of every k-mer of words that lies inside one text."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = words[:n].copy()
    for i in range(1, k):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i])
    ok = owner[:n] == owner[k - 1 :]
    return key[ok], owner[:n][ok], place[:n][ok]


def sketches(key: np.ndarray, owner: np.ndarray, place: np.ndarray, keep: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, band hashes, marks [texts, bands]) of the texts with at least ``keep`` k-mers.

    A mark is one byte of the smallest distinct k-mer of a band's hash function, whatever follows it: two texts agree in as
    many marks as they share distinct k-mers, so marks tell hopeless candidates without the texts.
    """
    size = np.bincount(owner) if len(owner) else np.zeros(0, np.int64)
    texts = np.flatnonzero(size >= keep)
    ok = np.isin(owner, texts, assume_unique=False) if len(texts) < len(size) else slice(None)
    key, owner, place = key[ok], owner[ok], place[ok]
    if not len(texts):
        return texts, np.zeros((0, bands), np.uint64), np.zeros((0, bands), np.uint8)
    # the occurrence number of equal k-mers of a text
    order = np.lexsort((place, key, owner))
    k, o = key[order], owner[order]
    fresh = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))
    first = np.flatnonzero(fresh)
    nth = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
    label = np.empty(len(k), np.uint64)
    label[order] = mix(k + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    again = np.empty(len(k), bool)
    again[order] = nth > 0
    repeats = bool(again.any())
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    count = np.diff(np.append(start, len(owner)))
    spot = place.astype(np.uint64) & _PLACE
    out, marks = np.empty((len(texts), bands), np.uint64), np.empty((len(texts), bands), np.uint8)
    for f in range(bands):
        value = (mix(label * np.uint64(2 * f + 1) + np.uint64(f * 0xA24BAED4963EE407 % (1 << 64))) & ~_PLACE) | spot
        low = np.empty((len(texts), keep), np.uint64)
        if repeats:
            once = np.where(again, _FULL, value)
            marks[:, f] = np.minimum.reduceat(once, start) >> _PLACE_BITS & np.uint64(0xFF)
            value = once if f % 4 == 3 else value
        for j in range(keep):
            low[:, j] = np.minimum.reduceat(value, start)
            if j < keep - 1:
                value[value == np.repeat(low[:, j], count)] = _FULL
        if not repeats:
            marks[:, f] = low[:, 0] >> _PLACE_BITS & np.uint64(0xFF)
        ranked = np.take_along_axis(low, np.argsort(low & _PLACE, axis=1, kind="stable"), 1) >> _PLACE_BITS
        band = np.full(len(texts), f + 1, np.uint64)
        for j in range(keep):
            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + ranked[:, j])
        out[:, f] = band
    return texts, out, marks


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    return np.bincount(o[np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1]))[: len(o)]], minlength=n)


def _sketch_rows(shingle: int, least: int, keep: int, bands: int):
    schema = pa.schema([("name", pa.string()), ("id", pa.int64()), ("kind", pa.int64()), ("words", pa.binary()), ("marks", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                words, lengths = word_hashes(batch.column(2).to_pylist())
                key, owner, place = kmers(words, lengths, shingle)
                large = _distinct(key, owner, batch.num_rows) >= least
                if shingle != K:
                    key, owner, place = kmers(words, lengths, K)
                ok = large[owner]
                texts, sketch, marks = sketches(key[ok], owner[ok], place[ok], keep, bands)
                ends = np.cumsum(lengths)
                names = batch.column(0).to_pylist()
                seeds = {n: np.uint64(xxhash.xxh3_64_intdigest(n or "")) for n in set(names)}
                salt = np.array([seeds[names[t]] for t in texts], np.uint64)
                raw = [words[ends[t] - lengths[t] : ends[t]].astype("<u4").tobytes() for t in texts]
                kind = mix(np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64) ^ salt)
                take = pa.array(texts, pa.int64())
                flat = mix(sketch ^ salt[:, None]).view(np.int64).ravel() if len(texts) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(texts) + 1) * bands).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(kind.view(np.int64)), pa.array(raw, pa.binary()), binary(marks), lists], schema=schema)

    return run


def _band_pairs(hot: int):
    """Pairs of the different kinds of each band, or (kind, null) for each kind of a hot one. Input sorted by band, kind."""

    def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), other], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, kinds, size = None, [], 0  # the open band's kinds, as long as it isn't hot

        def close() -> Iterator[pa.RecordBatch]:
            if 1 < size <= hot:
                k = np.concatenate(kinds)
                i, j = np.triu_indices(len(k), 1)
                yield rows(k[i], k[j])

        last = None
        for batch in batches:
            key, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(key):
                continue
            fresh = np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))
            fresh[0] = last is None or (key[0], kind[0]) != last
            last = (key[-1], kind[-1])
            key, kind = key[fresh], kind[fresh]
            if not len(key):
                continue
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            stop = np.append(start[1:], len(key))
            # whole small bands inside the batch, by size
            inner = np.ones(len(start), bool)
            inner[[0, -1]] = False
            for n in range(2, hot + 1):
                at = start[inner & (stop - start == n)]
                if len(at):
                    i, j = np.triu_indices(n, 1)
                    yield rows(kind[(at[:, None] + i).ravel()], kind[(at[:, None] + j).ravel()])
            for s, e in zip(start[inner & (stop - start > hot)], stop[inner & (stop - start > hot)]):
                yield rows(kind[s:e], None)
            for g in dict.fromkeys([0, len(start) - 1]):
                part = kind[start[g] : stop[g]]
                if band is None or key[start[g]] != band:
                    yield from close()
                    band, kinds, size = key[start[g]], [], 0
                if size <= hot < size + len(part):
                    yield from (rows(k, None) for k in kinds)
                    kinds = []
                size += len(part)
                if size > hot:
                    yield rows(part, None)
                else:
                    kinds.append(part)
        yield from close()

    return run


def _prefixes(words: DataFrame, shingle: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Candidate pairs of texts that share one of the shingles by which a pair of the threshold must agree."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.frombuffer(raw, "<u4").astype(np.uint64)
                key = np.unique(kmers(w, np.array([len(w)]), shingle)[0])
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.int64()), pa.array(key.view(np.int64)), pa.array([len(key)] * len(key), pa.int64())], names=["kind", "g", "n"])

    grams = scratch.save(words.select("kind", "words").mapInArrow(explode, "kind long, g long, n long"), "grams")
    often = grams.groupBy("g").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("df", "g"))
    first = grams.join(often, "g").where("df > 1").withColumn("rank", rank)
    # shingles of one text only come first, so the others' ranks start behind them
    alone = grams.join(often, "g").groupBy("kind").agg(F.count_if(F.col("df") == 1).alias("alone"))
    need = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    kept = first.join(alone, "kind").where(F.col("rank") + F.col("alone") <= need).select("g", "kind")
    other = kept.select("g", F.col("kind").alias("b"))
    return kept.withColumnRenamed("kind", "a").join(other, "g").where("a < b").select("a", "b").distinct()


def aligned(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
    """Words that stand in the same order in both texts of each pair, inside a band of ``width`` around the diagonal ``shift``.

    ``a`` and ``b`` are padded rows of word numbers; a band column ``c`` of row ``i`` stands for place ``i + shift + c - width // 2`` of b.
    """
    n, rows = a.shape
    best = np.zeros((n, width), np.int32)
    at = np.arange(n)[:, None]
    column = shift[:, None] + np.arange(width) - width // 2
    for i in range(rows):
        place = column + i
        inside = (place >= 0) & (place < lb[:, None]) & (i < la)[:, None]
        same = inside & (b[at, np.clip(place, 0, b.shape[1] - 1)] == a[:, i : i + 1])
        # the row above, one column to the right, is the same place of b; the same column is the place before
        up = np.concatenate([best[:, 1:], best[:, -1:]], axis=1)
        best = np.maximum.accumulate(np.maximum(up, best + same), axis=1)
    return best[:, -1]


def least_marks(threshold: float, bands: int) -> int:
    """Marks that a pair of the threshold has in common but for one in a million: the mean less 4.75 deviations."""
    return max(0, int(bands * threshold - 4.75 * (bands * threshold * (1 - threshold)) ** 0.5))


def _marked_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (matrix(batch.column(2), np.dtype("u1")) == matrix(batch.column(3), np.dtype("u1"))).sum(1)
                kept = batch.filter(pa.array(same >= least))
                yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    return run


def in_order(a: list[np.ndarray], b: list[np.ndarray], shift: np.ndarray, width: int, cells: int = 100_000) -> np.ndarray:
    """``aligned`` for pairs of sequences of any lengths; pairs of about the same length are aligned at once."""
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    found = np.zeros(len(a), np.int64)
    order = np.argsort(np.maximum(la, lb))
    s = len(order)
    while s:  # from the longest, as many as fit
        first = max(0, s - max(1, cells // max(1, int(max(la[order[s - 1]], lb[order[s - 1]])))))
        rows = order[first:s]
        pa_, pb = np.zeros((len(rows), la[rows].max()), np.uint32), np.zeros((len(rows), max(1, lb[rows].max())), np.uint32)
        for k, r in enumerate(rows):
            pa_[k, : la[r]], pb[k, : lb[r]] = a[r], b[r]
        found[rows] = aligned(pa_, pb, la[rows], lb[rows], shift[rows], width)
        s = first
    return found


def _verify_rows(shingle: int, width: int, threshold: float):
    """Candidates whose distinct shingles agree to the threshold, aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 400):
                part = batch.slice(s, 400)
                a = [np.frombuffer(x, "<u4") for x in part.column(2).to_pylist()]
                b = [np.frombuffer(x, "<u4") for x in part.column(3).to_pylist()]
                n = len(a)
                jac, shift = np.zeros(n), np.zeros(n, np.int64)
                for i, (x, y) in enumerate(zip(a, b)):
                    two = np.concatenate([x, y]).astype(np.uint64)
                    key, owner, place = kmers(two, np.array([len(x), len(y)]), shingle)
                    m = int((owner == 0).sum())
                    u, iu = np.unique(key[:m], return_index=True)
                    v, iv = np.unique(key[m:], return_index=True)
                    pos = np.minimum(np.searchsorted(v, u), len(v) - 1)
                    both = v[pos] == u
                    jac[i] = both.sum() / (len(u) + len(v) - both.sum())
                    if jac[i] >= threshold:
                        shift[i] = np.median(place[m:][iv[pos[both]]] - place[iu[both]])
                kept = np.flatnonzero(jac >= threshold)
                a, b = [a[i] for i in kept], [b[i] for i in kept]
                score = 2 * in_order(a, b, shift[kept], width) / np.array([len(x) + len(y) for x, y in zip(a, b)], float)
                take = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(jac[kept]), pa.array(score)], names=["a", "b", "jaccard", "aligned"])

    return run


def near_duplicates(texts: DataFrame, threshold: float, scratch: Scratch, shingle: int = 3, least: int = 20, band_width: int = 32, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) for ``texts`` of ``(name, id, text)``; records of different ``name`` are never compared.

    ``pairs``: ``(a, b, jaccard, aligned)``, pairs of different classes whose distinct shingles agree to ``threshold`` or
    more, with the share of words that a banded alignment brings together. ``members``: ``(name, id, kind)``, the class of
    every record that can match at all.
    """
    rows = "name string, id long, kind long, words binary, marks binary, bands array<long>"
    kept = texts.where("name is not null and id is not null").select("name", F.col("id").cast("long").alias("id"), "text")
    sketch = scratch.save(kept.mapInArrow(_sketch_rows(shingle, least, KEEP, BANDS), rows), "sketches")
    bands = sketch.select(F.explode("bands").alias("band"), "kind")
    met = scratch.save(bands.repartition("band").sortWithinPartitions("band", "kind").mapInArrow(_band_pairs(hot), "a long, b long").distinct(), "met")
    marks = sketch.select("kind", "marks").dropDuplicates(["kind"])
    near = met.where("b is not null").join(marks.select(F.col("kind").alias("a"), F.col("marks").alias("ma")), "a").join(marks.select(F.col("kind").alias("b"), F.col("marks").alias("mb")), "b")
    pairs = near.select("a", "b", "ma", "mb").mapInArrow(_marked_rows(least_marks(threshold, BANDS)), "a long, b long")
    crowded = met.where("b is null").select(F.col("a").alias("kind"))
    some_crowded = not crowded.isEmpty()
    if some_crowded:
        words = sketch.join(crowded.distinct(), "kind", "left_semi").select("kind", "words").dropDuplicates(["kind"])
        pairs = pairs.union(_prefixes(words, shingle, threshold, scratch)).distinct()
    pairs = scratch.save(pairs, "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("kind")).distinct()
    words = scratch.save(sketch.select("kind", "words").join(ends, "kind", "left_semi").dropDuplicates(["kind"]), "words")
    left = words.select(F.col("kind").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("kind").alias("b"), F.col("words").alias("wb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    checked = full.mapInArrow(_verify_rows(shingle, band_width, threshold), "a long, b long, jaccard double, aligned double")
    return checked, sketch.select("name", "id", "kind").distinct()


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(name, left_id, right_id)``: the pairs of classes, and of the members of one class, as pairs of records."""
    x = members.select("name", F.col("id").alias("x"), F.col("kind").alias("a"))
    y = members.select(F.col("id").alias("y"), F.col("kind").alias("b"))
    across = pairs.select("a", "b").join(x, "a").join(y, "b").select("name", "x", "y")
    inside = x.join(y, F.col("a") == F.col("b")).select("name", "x", "y")
    return across.unionAll(inside).where("x <> y").select("name", F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()
