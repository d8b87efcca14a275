"""Passages that texts share, exactly or with small edits, by seeds, chains and alignment.

Seeds are the k-mers of ``seed`` characters that have the smallest hash in some window of ``length - seed + 1`` successive
k-mers, so every shared span of ``length`` characters holds a seed that both texts chose. Seeds are joined by hash. Matches of
one diagonal whose seeds touch are one exact span, prolonged at either end by comparing the characters around the seeds; as an
equal stretch beyond the last seed would hold another one, that makes spans of ``length`` as long as they can be. All spans of a pair of
documents, whatever their size, are chained with gap costs through a Fenwick tree, and what lies between the spans of a
chain is aligned inside a band. ``passages`` are the chains with enough matched characters; ``shared_amounts`` counts the exact
spans of the chains that have one of ``length``.

Hot seeds, with more than ``HOT`` occurrences, are not all paired with each other. For ``shared_amounts`` each of their occurrences is
described by all spans of ``length`` characters that cover the seed; of the occurrences of one such span each is matched with the span's
first document (and that one with its last), which covers the same characters of every document with a linear number of
matches. For ``passages`` every pair of documents that may have a passage is found first, and has the matches of all hot seeds that both have:
a match that ends inside its contexts on both sides is shorter than a passage, so such a pair has another match, by a seed
that is not hot, by a seed whose characters up to the end of a context are the same, or by a second hot seed within ``MAX_GAP``. Equal texts are one class: they share their whole length, and one member stands for the class towards others.

Defined results: null texts and texts shorter than ``length`` share nothing; rows with a null id are left out; rows
that repeat a document id are one document, and what occurs only inside one document is not shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.arrow import groups
from threadloom.llm import grid
from threadloom.llm.omh import in_order
from threadloom.session import Scratch

#: Occurrences of a seed that are paired with each other, at most.
HOT = 24
#: What a skipped character takes from a chain's score, the characters by which successive matches may overlap at either end, and the
#: skipped characters of either side beyond which a chain is cut in two.
GAP_COST, SLACK, MAX_GAP = 0.05, 16, 500
#: Width of the band in which the characters between the matches of a chain are aligned.
BAND = 48
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _MULT, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _INVERSE, np.uint64)
        steps[0] = 1
        _INVERSES = np.multiply.accumulate(steps)
    return _INVERSES[:n]


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over each window of ``width`` successive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def chosen_seeds(chars: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the seeds of a run of characters (code points)."""
    n = len(chars) - seed + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = (chars.astype(np.uint64) + np.uint64(0x1F)) * np.uint64(0x2545F4914F6CDD1D)
    value ^= value >> np.uint64(29)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(value * _powers(len(chars)), out=total[1:])
    key = _mix((total[seed:] - total[:-seed]) * _inverses(n))
    low = _slide(key, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    is_low = _slide(np.concatenate([pad, low, pad]), window, np.maximum) == key
    at = np.flatnonzero(is_low)
    return at, key[at]


def text_seeds(chars: np.ndarray, seed: int, window: int, portion: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of a text of any length, in portions that overlap by all but one character of a span."""
    if len(chars) <= 2 * portion:
        return chosen_seeds(chars, seed, window)
    found = []
    for start in range(0, len(chars), portion):
        at, key = chosen_seeds(chars[start : start + portion + seed + window - 2], seed, window)
        found.append((at + start, key))
    at, first = np.unique(np.concatenate([a for a, _ in found]), return_index=True)
    return at, np.concatenate([k for _, k in found])[first]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _seed_rows(length: int, seed: int):
    window = length - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], [], []]
            rows = 0

            def flush() -> pa.RecordBatch:
                cols = [np.concatenate(c) for c in out]
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3].astype(np.int32))], names=["h", "kind", "doc", "pos"])

            for i in range(batch.num_rows):
                at, key = text_seeds(_code_points(batch.column(2)[i].as_py()), seed, window)
                for c, v in zip(out, (key, np.full(len(at), kinds[i]), np.full(len(at), docs[i]), at)):
                    c.append(v)
                rows += len(at)
                if rows > 500_000:
                    yield flush()
                    rows = 0
            if rows:
                yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (sorted by h, kind, doc, pos) of the hashes that occur in two different texts; one document per text."""
    names = ["h", "kind", "doc", "pos"]
    held: list[pa.RecordBatch] = []  # start of the open group, as long as it has one text
    state: tuple | None = None  # (h, kind, doc)
    open_ = False

    for batch in batches:
        h, kind, doc = (np.asarray(batch.column(i)) for i in range(3))
        n = len(h)
        if not n:
            continue
        new_h = np.append(True, h[1:] != h[:-1])
        new_k = new_h | np.append(True, kind[1:] != kind[:-1])
        if state is not None:
            new_h[0] = h[0] != state[0]
            new_k[0] = new_h[0] or kind[0] != state[1]
        # the first document of a text stands for all that have it
        first = np.where(new_k, np.arange(n), -1)
        first = np.maximum.accumulate(first)
        leader = np.where(first >= 0, doc[np.maximum(first, 0)], state[2] if state is not None else 0)
        keep = doc == leader
        group = np.cumsum(new_h)  # 0: continues the open group
        kinds = np.bincount(group, weights=new_k, minlength=int(group[-1]) + 1)
        last = int(group[-1])
        multi = kinds > 1
        if group[0] == 0:
            multi[0] = open_ or kinds[0] > 0
        mask = keep & multi[group]
        if group[0] == 0 and held:
            if multi[0]:
                yield from held
            if multi[0] or last > 0:
                held = []
        elif held:
            held = []
        if not multi[last]:
            held.append(batch.filter(pa.array(keep & (group == last))))
        open_ = bool(multi[last])
        state = (h[-1], kind[-1], leader[-1])
        if mask.any():
            part = batch.filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays(part.columns, names=names)


def _contexts(length: int, seed: int):
    """The characters before and after each hit of a text, as many as a span of ``length`` may have beside the seed."""
    reach = length - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            flat, size = hits.flatten(), np.asarray(hits.value_lengths())
            pos, h = pc.struct_field(flat, "pos"), pc.struct_field(flat, "h")
            doc = np.repeat(np.asarray(batch.column(0)), size)
            at = np.asarray(pos).tolist()
            before, after, k = [], [], 0
            for text, n in zip(batch.column(1).to_pylist(), size.tolist()):
                for p in at[k : k + n]:
                    before.append(text[max(0, p - reach) : p])
                    after.append(text[p + seed : p + seed + reach])
                k += n
            yield pa.RecordBatch.from_arrays([h, pa.array(doc), pos, pa.array(before, pa.string()), pa.array(after, pa.string())], names=["h", "doc", "pos", "before", "after"])

    return run


def _padded(texts: list[str], width: int, right: bool) -> np.ndarray:
    """Characters of the texts, counted from the seed outwards; missing ones differ from everything."""
    out = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        c = _code_points(t)
        c = c if right else c[::-1]
        out[i, : len(c)] = c + 1
    return out


def _equal_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a == b) & (a > 0)
    return np.where(same.all(1), same.shape[1], np.argmin(same, axis=1))


def _pair_rows(length: int, seed: int):
    """Matches of the seeds that are not hot: (a, b, pos_a, pos_b, size), prolonged as far as the contexts agree."""
    reach = length - seed
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pos_a", pa.int32()), ("pos_b", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, pos, before, after, left, right = [], [], [], [], [], []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, pos, before, after, left, right, n
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                d, p = np.concatenate(docs), np.concatenate(pos)
                lb, ra = _padded(before, reach, False), _padded(after, reach, True)
                for s in range(0, len(i), 20_000):
                    x, y = i[s : s + 20_000], j[s : s + 20_000]
                    swap = d[x] > d[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip((d[x], d[y], p[x], p[y], _equal_run(lb[x], lb[y]), _equal_run(ra[x], ra[y])), schema)], schema=schema)
            docs, pos, before, after, left, right, n = [], [], [], [], [], [], 0

        for _, parts in groups(batches, 1):  # at most HOT rows
            table = pa.Table.from_batches(parts)
            d = np.asarray(table.column("doc"))
            m = len(d)
            i, j = np.triu_indices(m, 1)
            ok = d[i] != d[j]
            if ok.any():
                docs.append(d)
                pos.append(np.asarray(table.column("pos")))
                before += table.column("before").to_pylist()
                after += table.column("after").to_pylist()
                left.append(i[ok] + n)
                right.append(j[ok] + n)
                n += m
            if n > 20_000:
                yield from flush()
        yield from flush()

    return run


def _hot_matches(hot: DataFrame, length: int, seed: int) -> DataFrame:
    """Matches of hot seeds by the spans of ``length`` characters around them, linear in the occurrences."""
    reach = length - seed
    spans = hot.select("h", "doc", "pos", "before", "after", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("o"))
    whole = (F.length("before") >= F.col("o")) & (F.length("after") >= reach - F.col("o"))
    left = F.expr("substring(before, length(before) - o + 1, o)")
    grams = spans.where(whole).select(
        F.xxhash64("h", "o", left, F.expr(f"substring(after, 1, {reach} - o)")).alias("g"), "doc", (F.col("pos") - F.col("o")).alias("start")
    )
    ends = grams.groupBy("g").agg(F.min(F.struct("doc", "start")).alias("lo"), F.max(F.struct("doc", "start")).alias("hi")).where("lo.doc <> hi.doc")
    hit = grams.join(ends, "g")
    partner = F.when(F.col("doc") == F.col("lo.doc"), F.col("hi")).otherwise(F.col("lo"))
    both = hit.select("doc", "start", partner.alias("p"))
    first = F.col("doc") < F.col("p.doc")
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return both.select(
        pick(F.col("doc"), F.col("p.doc")).alias("a"), pick(F.col("p.doc"), F.col("doc")).alias("b"), pick(F.col("start"), F.col("p.start")).cast("int").alias("pos_a"),
        pick(F.col("p.start"), F.col("start")).cast("int").alias("pos_b"), F.lit(0).alias("before"), F.lit(reach).alias("after"),
    ).distinct()


def _hot_partners(occurrences: DataFrame, length: int, seed: int) -> DataFrame:
    """``(a, b)``: documents with a hot seed whose context is the same up to its end, or with two hot seeds that can be in one chain."""
    reach = length - seed
    whole = lambda side: F.when(F.length(side) == reach, F.xxhash64(F.lit(side), "h", side))
    open_ = occurrences.select("doc", F.explode(F.array(whole("before"), whole("after"))).alias("k"), F.lit(0).alias("gap")).where("k is not null")
    x, y = (occurrences.select("doc", F.col("h").alias(f"h{i}"), F.col("pos").alias(f"p{i}")) for i in (1, 2))
    gap = F.col("p2") - F.col("p1")
    two = x.join(y, "doc").where((gap > 0) & (gap <= MAX_GAP + seed + 2 * reach)).select("doc", F.xxhash64(F.lit("two"), "h1", "h2").alias("k"), gap.alias("gap"))
    keys = open_.unionByName(two).groupBy("k", "doc").agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"))
    left, right = (keys.select("k", F.col("doc").alias(d), F.col("lo").alias(f"lo_{d}"), F.col("hi").alias(f"hi_{d}")) for d in "ab")
    # seeds that touch and are equally far apart on both sides are one span
    one = (F.col("hi_a") > 0) & (F.greatest("hi_a", "hi_b") == F.least("lo_a", "lo_b")) & (F.col("hi_a") <= seed)
    return left.join(right, "k").where((F.col("a") < F.col("b")) & ~one).select("a", "b")


def _stretches(pos: np.ndarray, after: list[str], seed: int, length: int) -> list[tuple[tuple | None, np.ndarray]]:
    """(key, places) of the occurrences of one seed in a text: those that follow each other at one distance, with the same characters
    between, by distance and characters; all others together, with no key."""
    n = len(pos)
    step = np.diff(pos)
    keys = [(d, after[i][: max(0, d - seed)]) if d <= length else None for i, d in enumerate(step.tolist())]
    found, rest, i = [], [], 0
    while i < n:
        j = i
        while j < n - 1 and keys[j] is not None and keys[j] == keys[i]:
            j += 1
        if j > i:
            found.append((keys[i], np.arange(i, j + 1)))
        else:
            rest.append(i)
        i = j + 1
    return [*found, (None, np.array(rest, np.int64))] if rest else found


#: Occurrences of a seed in two documents, multiplied, above which those that repeat at one distance are matched diagonal by diagonal.
CROSS = 1024


def _crossed(pos_a: np.ndarray, after_a: list[str], pos_b: np.ndarray, after_b: list[str], seed: int, length: int) -> tuple[np.ndarray, ...]:
    """(first_a, first_b, last_a, last_b): places of the occurrences of a seed in two texts that match; from the first to the last one
    the texts are equal, so every pair of places is in one of the rows."""
    if len(pos_a) * len(pos_b) <= CROSS:
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(pos_a)), np.arange(len(pos_b)), indexing="ij"))
        return i, j, i, j
    out = []
    parts = _stretches(pos_b, after_b, seed, length)
    for key, x in _stretches(pos_a, after_a, seed, length):
        for other, y in parts:
            if key is not None and key == other:
                shift = np.arange(1 - len(y), len(x))
                i, j = np.maximum(shift, 0), np.maximum(-shift, 0)
                n = np.minimum(len(x) - i, len(y) - j) - 1
                out.append((x[i], y[j], x[i + n], y[j + n]))
            else:
                i, j = (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
                out.append((i, j, i, j))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(4))


def _hot_rows(length: int, seed: int):
    """Matches of a hot seed in two documents, from all its occurrences in either: (a, b, pos_a, pos_b, before, after)."""
    reach = length - seed
    kinds = (("a", pa.int64()), ("b", pa.int64()), ("pos_a", pa.int32()), ("pos_b", pa.int32()), ("before", pa.int32()), ("after", pa.int32()))
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for c in (2, 3):
                hits = batch.column(c)
                flat = hits.flatten()
                before, after = (pc.struct_field(flat, f).to_pylist() for f in ("before", "after"))
                ends = np.append(0, np.cumsum(np.asarray(hits.value_lengths())))
                sides.append((np.asarray(pc.struct_field(flat, "pos")), before, after, ends))
            (pa_, ba, aa, ea), (pb, bb, ab, eb) = sides
            found, row = [], []
            for r in range(batch.num_rows):
                x, y = slice(ea[r], ea[r + 1]), slice(eb[r], eb[r + 1])
                at = _crossed(pa_[x], aa[x], pb[y], ab[y], seed, length)
                found.append((at[0] + ea[r], at[1] + eb[r], at[2] + ea[r], at[3] + eb[r]))
                row.append(np.full(len(at[0]), r))
            i, j, p, q = (np.concatenate([f[c] for f in found]) for c in range(4))
            row = np.concatenate(row)
            a, b = np.asarray(batch.column(0))[row], np.asarray(batch.column(1))[row]
            # the contexts of each occurrence are laid out once, however many it meets
            la, lb, ra, rb = _padded(ba, reach, False), _padded(bb, reach, False), _padded(aa, reach, True), _padded(ab, reach, True)
            for s in range(0, len(i), 20_000):
                e = slice(s, s + 20_000)
                after = pa_[p[e]] - pa_[i[e]] + _equal_run(ra[p[e]], rb[q[e]])
                cols = (a[e], b[e], pa_[i[e]], pb[j[e]], _equal_run(la[i[e]], lb[j[e]]), after)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(cols, kinds)], schema=schema)

    return run


def _hot_pairs(hot: DataFrame, cold: DataFrame, length: int, seed: int, scratch: Scratch) -> DataFrame:
    """Matches of hot seeds between all documents that may have a passage in common; ``cold`` are the matches of the other seeds."""
    hot = scratch.save(hot, f"occurrences-{length}")
    pairs = scratch.save(_hot_partners(hot, length, seed).unionByName(cold.select("a", "b")).distinct(), f"partners-{length}")
    hits = scratch.save(hot.groupBy("h", "doc").agg(F.sort_array(F.collect_list(F.struct("pos", "before", "after"))).alias("hits")), f"hits-{length}")  # bounded by the document
    left, right = (hits.select("h", F.col("doc").alias(d), F.col("hits").alias(f"hits_{d}")) for d in "ab")
    both = pairs.join(left, "a").join(right, ["h", "b"]).select("a", "b", "hits_a", "hits_b")
    return both.mapInArrow(_hot_rows(length, seed), "a long, b long, pos_a int, pos_b int, before int, after int")


class Fenwick:
    """Greatest value over a prefix, with its place; values only grow."""

    def __init__(self, size: int) -> None:
        self.best, self.at = [-1e18] * (size + 1), [-1] * (size + 1)

    def update(self, i: int, value: float, place: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i], self.at[i] = value, place
            i += i & -i

    def query(self, i: int) -> tuple[float, int]:
        """Over places below ``i``."""
        value, place = -1e18, -1
        while i > 0:
            if self.best[i] > value:
                value, place = self.best[i], self.at[i]
            i -= i & -i
        return value, place


def chain(start_a: np.ndarray, start_b: np.ndarray, size: np.ndarray, gap: float = GAP_COST) -> np.ndarray:
    """Chain number of each match: repeatedly the best chain of matches in order on both sides, ``gap`` a skipped character.

    The score of a chain is its matched characters less ``gap`` times those skipped on both sides. Successive matches may
    overlap by a quarter of either, ``SLACK`` characters a side at most, as matches around an edit often do. Every match is in exactly one chain.
    """
    n = len(size)
    if n == 1:
        return np.zeros(1, np.int64)
    slack = np.minimum(size // 4, SLACK)
    from_a, from_b, to_a, to_b = start_a + slack, start_b + slack, start_a + size - slack, start_b + size - slack
    values = np.unique(np.concatenate([from_b, to_b]))
    by_start = np.lexsort((from_b, from_a)).tolist()
    by_end = np.lexsort((to_b, to_a)).tolist()
    rank_start, rank_end = np.searchsorted(values, from_b).tolist(), np.searchsorted(values, to_b).tolist()
    sa, sb, ea, eb, sz = from_a.tolist(), from_b.tolist(), to_a.tolist(), to_b.tolist(), size.tolist()
    # one sweep: f = best score of a chain that ends with the match; a predecessor ends before it on both sides
    tree = Fenwick(len(values))
    score, back, done = [0.0] * n, [-1] * n, 0
    for m in by_start:
        while done < n and ea[by_end[done]] <= sa[m]:
            p = by_end[done]
            tree.update(rank_end[p], score[p] + gap * (ea[p] + eb[p]), p)
            done += 1
        value, p = tree.query(rank_start[m] + 1)
        gain = value - gap * (sa[m] + sb[m])
        if p >= 0 and gain > 0:
            score[m], back[m] = gain + sz[m], p
        else:
            score[m] = float(sz[m])
    number = [-1] * n
    next_ = 0
    for m in sorted(range(n), key=lambda i: (-score[i], i)):
        if number[m] >= 0:
            continue
        at = m
        while at >= 0 and number[at] < 0:
            number[at] = next_
            at = back[at]
        next_ += 1
    return np.array(number, np.int64)


def exact_runs(pos_a: np.ndarray, pos_b: np.ndarray, before: np.ndarray, after: np.ndarray, seed: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start_a, start_b, size) of the exact spans: touching seeds of one diagonal, prolonged at the ends."""
    order = np.lexsort((pos_a, pos_a - pos_b))
    a, b = pos_a[order].astype(np.int64), pos_b[order].astype(np.int64)
    lo, hi = a - before[order], a + seed + after[order]
    diagonal = a - b
    fresh = np.append(True, diagonal[1:] != diagonal[:-1])
    # a run is left where the next stretch of the diagonal begins beyond all before it
    shift = (np.cumsum(fresh) - 1) * (int(hi.max()) + step + seed + 1 if len(hi) else 1)
    reach = np.maximum.accumulate(hi + shift)
    fresh[1:] |= lo[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    start = np.minimum.reduceat(lo, first)
    stop = np.maximum.reduceat(hi, first)
    return start, start - diagonal[first], stop - start


_SPAN = pa.struct([("start_a", pa.int32()), ("start_b", pa.int32()), ("size", pa.int32())])
_GAP = pa.struct([("lo_a", pa.int32()), ("n_a", pa.int32()), ("lo_b", pa.int32()), ("n_b", pa.int32())])
_CHAIN = (
    "a long, b long, chain int, start_a int, end_a int, start_b int, end_b int, matched long, "
    "spans array<struct<start_a: int, start_b: int, size: int>>, gaps array<struct<lo_a: int, n_a: int, lo_b: int, n_b: int>>"
)


def _chain_rows(length: int, seed: int, least: int, longest: int):
    """One row for each chain of a pair's matches that may come to ``least`` matched characters and has an exact span of ``longest``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((n, pa.int32()) for n in ("chain", "start_a", "end_a", "start_b", "end_b")), ("matched", pa.int64()), ("spans", pa.list_(_SPAN)), ("gaps", pa.list_(_GAP))])
    int32 = lambda v: pa.array(np.asarray(v).astype(np.int32))

    def rows(key: list[tuple[int, int]], cols: list[tuple]) -> pa.RecordBatch:
        chain_of, sa, sb, n, ga, gb = (np.concatenate([c[i] for c in cols]) for i in range(6))
        pair = np.repeat(np.arange(len(key)), [len(c[0]) for c in cols])
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (chain_of[1:] != chain_of[:-1])))
        inner = np.append(first, len(n))
        over = np.maximum(0, np.maximum(-ga, -gb))
        matched = np.add.reduceat(n - over, first)
        hopeful = (matched + np.add.reduceat(np.maximum(0, np.minimum(ga, gb)), first) >= least) & (np.maximum.reduceat(n, first) >= longest)
        keep = np.repeat(hopeful, np.diff(inner))
        # what is between two matches is to be aligned, unless one side has nothing there or both a single character, which then differ
        open_ = keep & (np.minimum(ga, gb) > 0) & (np.maximum(ga, gb) > 1)
        offsets = lambda mask: np.append(0, np.cumsum(np.add.reduceat(mask, first)[hopeful]))
        spans = pa.StructArray.from_arrays([int32(sa[keep]), int32(sb[keep]), int32(n[keep])], fields=list(_SPAN))
        gaps = pa.StructArray.from_arrays([int32(v[open_]) for v in (sa - ga, ga, sb - gb, gb)], fields=list(_GAP))
        last = (inner[1:] - 1)[hopeful]
        head = first[hopeful]
        ids = np.array(key, np.int64).reshape(-1, 2)[pair[head]]
        stop_a, stop_b = np.maximum.reduceat(sa + n, first)[hopeful], (sb + n)[last]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:, 0]), pa.array(ids[:, 1]), int32(chain_of[head]), int32(sa[head]), int32(stop_a), int32(sb[head]), int32(stop_b), pa.array(matched[hopeful].astype(np.int64)),
             pa.ListArray.from_arrays(int32(offsets(keep.astype(np.int64))), spans), pa.ListArray.from_arrays(int32(offsets(open_.astype(np.int64))), gaps)], schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: list[tuple[int, int]] = []
        cols: list = []
        total = 0
        for pair, parts in groups(batches, 2):
            start_a, start_b, size = exact_runs(*(np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in range(2, 6)), seed, length - seed + 1)
            number = chain(start_a, start_b, size)
            order = np.lexsort((start_b, start_a, number))
            sa, sb, n, number = start_a[order], start_b[order], size[order], number[order]
            fresh = np.append(True, number[1:] != number[:-1])
            ga, gb = np.append(0, sa[1:] - sa[:-1] - n[:-1]), np.append(0, sb[1:] - sb[:-1] - n[:-1])
            fresh |= (ga > MAX_GAP) | (gb > MAX_GAP)
            ga, gb = np.where(fresh, 0, ga), np.where(fresh, 0, gb)
            key.append(pair)
            cols.append((np.cumsum(fresh) - 1, sa, sb, n, ga, gb))
            total += len(n)
            if total > 20_000:
                yield rows(key, cols)
                key, cols, total = [], [], 0
        if key:
            yield rows(key, cols)

    return run


def _aligned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters in order that both sides of a gap have, inside a band around the diagonal of its start or that of its end."""
    for batch in batches:
        if batch.num_rows:
            a, b = ([_code_points(t) for t in batch.column(i).to_pylist()] for i in (4, 5))
            shift = np.array([len(y) - len(x) for x, y in zip(a, b)], np.int64)
            same = np.maximum(in_order(a, b, np.zeros(len(a), np.int64), BAND), in_order(a, b, shift, BAND))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same)], names=["a", "b", "chain", "lo_a", "same"])


def text_classes(docs: DataFrame, ident: str, text: str, length: int) -> DataFrame:
    """``(doc, kind, n)``: documents of at least ``length`` characters with the hash and the size of their text."""
    return docs.where(F.col(ident).isNotNull() & (F.length(F.col(text)) >= length)).select(
        F.col(ident).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("kind"), F.length(F.col(text)).alias("n")
    )


def _matches(docs: DataFrame, ident: str, text: str, length: int, scratch: Scratch, seed: int, every: bool = False) -> DataFrame:
    """``(a, b, pos_a, pos_b, before, after)``: seeds that two documents share, and how far the texts agree around them; of hot seeds
    those that cover the shared characters of each document, or with ``every`` those of each two documents that may have a passage."""
    if length - seed + 1 > seed:
        raise ValueError("the seed must be at least half the length")
    long = docs.where(F.col(ident).isNotNull() & (F.length(F.col(text)) >= length)).select(F.col(ident).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("kind"), F.col(text).alias("text"))
    rows = "h long, kind long, doc long, pos int"
    seeds = long.mapInArrow(_seed_rows(length, seed), rows)
    common = seeds.repartition("h").sortWithinPartitions("h", "kind", "doc", "pos").mapInArrow(_shared, rows)
    per_doc = common.groupBy("doc", "kind").agg(F.collect_set(F.struct("pos", "h")).alias("hits"))  # bounded by the document
    found = scratch.save(long.join(per_doc, ["doc", "kind"]).select("doc", "text", "hits").mapInArrow(_contexts(length, seed), "h long, doc long, pos int, before string, after string"), f"contexts-{length}")
    hot = found.groupBy("h").count().where(F.col("count") > HOT).select("h")
    match = "a long, b long, pos_a int, pos_b int, before int, after int"
    hot = scratch.save(hot, f"hot-{length}")
    some_hot = not hot.isEmpty()
    cold = found.join(hot, "h", "left_anti") if some_hot else found
    matches = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_pair_rows(length, seed), match)
    if some_hot and every:
        matches = scratch.save(matches, f"cold-{length}")
        matches = matches.unionByName(_hot_pairs(found.join(hot, "h"), matches, length, seed, scratch))
    elif some_hot:
        matches = matches.unionByName(_hot_matches(found.join(hot, "h"), length, seed))
    return matches


def _aligned_chains(matches: DataFrame, docs: DataFrame, ident: str, text: str, length: int, seed: int, least: int, longest: int, scratch: Scratch) -> DataFrame:
    """Chains of the matches with at least ``least`` matched characters, those aligned between the matches included."""
    chains = scratch.save(matches.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_chain_rows(length, seed, least, longest), _CHAIN), f"chains-{length}")
    key = ["a", "b", "chain"]
    gaps = chains.where(F.size("gaps") > 0).select(*key, F.explode("gaps").alias("g")).select(*key, "g.*")
    texts = docs.where(F.col(ident).isNotNull() & (F.length(F.col(text)) >= length)).select(F.col(ident).cast("long").alias("doc"), F.col(text).alias("text"))
    cut = lambda lo, n: F.col("text").substr(F.col(lo) + 1, F.col(n))
    left = gaps.join(texts, F.col("a") == F.col("doc")).select(*key, "lo_a", "lo_b", "n_b", cut("lo_a", "n_a").alias("ta"))
    both = left.join(texts, F.col("b") == F.col("doc")).select(*key, "lo_a", "ta", cut("lo_b", "n_b").alias("tb"))
    same = both.mapInArrow(_aligned_rows, "a long, b long, chain int, lo_a int, same long").groupBy(*key, "lo_a").agg(F.max("same").alias("same"))
    total = same.groupBy(*key).agg(F.sum("same").alias("same"))
    every = chains.join(total, key, "left").withColumn("matched", F.col("matched") + F.coalesce("same", F.lit(0)))
    return every.where(F.col("matched") >= least).drop("same", "gaps")


def shared_amounts(docs: DataFrame, ident: str, text: str, length: int, scratch: Scratch, seed: int = 0) -> DataFrame:
    """``(doc, shared_chars)``: characters of each document that lie in a span shared with another one; above 0 only.

    The spans are the exact ones of the aligned chains of length ``length`` or more.
    """
    seed = seed or max(1, (2 * length) // 3)
    chains = _aligned_chains(_matches(docs, ident, text, length, scratch, seed), docs, ident, text, length, seed, length, length, scratch)
    spans = chains.select("a", "b", F.explode("spans").alias("s")).where(F.col("s.size") >= length)
    ends = spans.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("s.start_a").alias("lo"), "s.size"), F.struct(F.col("b").alias("doc"), F.col("s.start_b").alias("lo"), "s.size"))).alias("s"))
    parts = ends.select("s.doc", F.col("s.lo").alias("lo"), (F.col("s.lo") + F.col("s.size")).alias("hi"))
    classes = text_classes(docs, ident, text, length).distinct()
    copied = classes.groupBy("kind").agg(F.count("*").alias("c")).where("c > 1").select("kind")
    whole = classes.join(copied, "kind").select("doc", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    every = parts.unionByName(whole).groupBy("doc", "lo").agg(F.max("hi").alias("hi"))
    seen = F.max("hi").over(Window.partitionBy("doc").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.col("seen"), F.lit(0))))
    return every.withColumn("seen", seen).groupBy("doc").agg(F.sum(new).alias("shared_chars")).where("shared_chars > 0")


def passages(docs: DataFrame, ident: str, text: str, length: int, scratch: Scratch) -> DataFrame:
    """``(a, b, chain, start_a, end_a, start_b, end_b, n_spans, matched, identity, class_id)``: chains with at least ``length`` matched characters.

    A chain is made of exact spans of two thirds of ``length`` or more, so a passage may have an edit that often; what is
    between them is aligned. ``identity`` is the share of matched characters in the longer side. Each two texts that have such a chain have its
    row, however many others have the same characters.

    Each further document of a text has one row, over its whole length, with the text's first document, which stands for it
    in the other rows. Rows of one ``class_id`` are the same or overlapping passages: stretches of a document that have
    ``length`` characters in common are one, and rows link stretches.
    """
    least = max(1, (2 * length) // 3)
    seed = max(1, (2 * least) // 3)
    matches = _matches(docs, ident, text, least, scratch, seed, every=True)
    chains = _aligned_chains(matches, docs, ident, text, least, seed, length, 0, scratch)
    chains = chains.select("a", "b", "chain", "start_a", "end_a", "start_b", "end_b", F.size("spans").cast("long").alias("n_spans"), "matched")
    classes = text_classes(docs, ident, text, length).distinct()
    first = classes.groupBy("kind").agg(F.min("doc").alias("a"), F.count("*").alias("c")).where("c > 1").select("kind", "a")
    zero, n = F.lit(0), F.col("n")
    copies = classes.join(first, "kind").where("doc <> a").select(
        "a", F.col("doc").alias("b"), zero.alias("chain"), zero.alias("start_a"), n.alias("end_a"), zero.alias("start_b"), n.alias("end_b"), F.lit(1).cast("long").alias("n_spans"), n.cast("long").alias("matched")
    )
    wide_side = F.greatest(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b"))
    rows = scratch.save(chains.unionByName(copies).withColumn("identity", F.round(F.least(F.lit(1.0), F.col("matched") / wide_side), 4)), "passages")
    sides = F.array(*(F.struct(F.col(d).alias("doc"), F.col(f"start_{d}").alias("lo"), F.col(f"end_{d}").alias("hi")) for d in "ab"))
    parts = rows.select(F.explode(sides).alias("s")).select("s.*").groupBy("doc", "lo").agg(F.max("hi").alias("hi"))
    order = Window.partitionBy("doc").orderBy("lo")
    fresh = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) - F.col("lo") < length, F.lit(True))
    begun = F.max(F.when(F.col("fresh"), F.col("lo"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    regions = scratch.save(parts.withColumn("fresh", fresh).select("doc", "lo", F.xxhash64("doc", begun).alias("region")), "regions")
    left, right = (regions.select(F.col("doc").alias(d), F.col("lo").alias(f"start_{d}"), F.col("region").alias(f"region_{d}")) for d in "ab")
    placed = scratch.save(rows.join(left, ["a", "start_a"]).join(right, ["b", "start_b"]), "placed")
    linked = grid.groups(placed, "region_a", "region_b", scratch).select(F.col("group_id").alias("class_id"), F.col("member_id").alias("region_a"))
    return placed.join(linked, "region_a").select(*rows.columns, "class_id")
