"""Keyword search over a stored inverted index, semantic search, and both together.

The index is built once for a corpus: ``postings`` ``(term, bucket, doc, tf, places)``, written in folders by ``bucket``, a hash of the
term, and sorted by term inside, so that a search reads the buckets of its terms and of these the row groups that hold
them; ``lengths`` ``(doc, dl)``; and one row of statistics. The start of a word is looked for in all buckets, whose
files are sorted, so that only row groups that may hold it are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.config import BM25_B, BM25_K1, BM25_LEAST_IDF, SEARCH_LIMIT, SEMANTIC_FLOOR
from threadloom.functions.text import tokens_of
from threadloom.functions.vectors import cosine
from threadloom.session import Scratch

#: Folders that the postings are dealt into by a hash of the term.
BUCKETS = 64


def postings(documents: DataFrame, ident: str, texts: list[str]) -> DataFrame:
    """``(term, n_documents, n_occurrences)`` of the inverted index; counted inside each document before the shuffle."""
    words = documents.select(F.col(ident).alias("doc"), F.explode(tokens_of(*(F.col(t) for t in texts))).alias("term"))
    per = words.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("n_documents"), F.sum("tf").alias("n_occurrences"))


def bm25(documents: DataFrame, ident: str, texts: list[str], terms: list[str]) -> DataFrame:
    """``(ident, bm25)`` of the documents that have all terms, without an index. Greater is better.

    One pass over the text and no shuffle of it: its counts are written as a narrow table, from which the statistics (a
    single row) and the scores are taken.
    """
    words = tokens_of(*(F.col(t) for t in texts))

    def occurrences(term: str) -> Column:
        return F.size("words") - F.size(F.array_remove("words", term))

    tf = [occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = documents.select(F.col(ident), words.alias("words")).select(ident, F.size("words").alias("dl"), *tf)
    counted = Scratch(documents.sparkSession).save(counted, "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    both = counted.where(reduce(lambda a, b: a & b, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).join(F.broadcast(stats))  # one row
    length = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))

    def part(i: int):
        t, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(BM25_LEAST_IDF), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        return idf * t * (BM25_K1 + 1) / (t + length)

    return both.select(ident, reduce(lambda a, b: a + b, (part(i) for i in range(len(terms)))).alias("bm25"))


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of each document, with its places; a document lies in one row, so nothing is shuffled for it."""
    for batch in batches:
        words = batch.column(1)
        flat, size = words.flatten().dictionary_encode(), np.asarray(words.value_lengths())
        if not len(flat):
            continue
        code, owner = np.asarray(flat.indices, np.int64), np.repeat(np.arange(len(size)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        key = owner * len(flat.dictionary) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        offsets = np.append(first, len(order)).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order].astype(np.int32)))
        at = order[first]
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[at])), batch.column(0).take(pa.array(owner[at])), pa.array(np.diff(offsets)), places], names=["term", "doc", "tf", "places"])


def build_index(documents: DataFrame, ident: str, texts: list[str], root: str) -> TextIndex:
    """Write the index of all documents below ``root``. Documents with a null id are left out; rows of one id are one document."""
    words = tokens_of(*(F.col(t) for t in texts))
    docs = documents.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("doc"), words.alias("words"))
    per = docs.mapInArrow(_posted, "term string, doc long, tf int, places array<int>")
    per.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    spark = documents.sparkSession
    counted = spark.read.parquet(f"{root}/postings").groupBy("doc").agg(F.sum("tf").alias("dl"))
    ids = docs.select("doc").distinct().join(counted, "doc", "left")
    ids.select("doc", F.coalesce("dl", F.lit(0)).alias("dl")).write.mode("overwrite").parquet(f"{root}/lengths")
    spark.read.parquet(f"{root}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{root}/stats")
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{root}/{name}") for name in ("postings", "lengths", "stats")))


@dataclass(frozen=True)
class Phrase:
    """Words that follow one another; the last one may be the start of a word."""

    words: tuple[str, ...]
    prefix: bool = False


_PART = re.compile(r'\s*(?:(\()|(\))|"((?:[^"]|"")*)"\s*(\*?)|([^\s()"]+))')
_WORD = re.compile(r"[^\W_]+")


def parse_query(text: str):
    """The tree of a query: ``Phrase``, or ``(operator, left, right)`` with ``and``, ``or``, ``not``.

    Parts side by side must all match; ``NOT`` binds strongest, then ``AND``, then ``OR`` (all in capitals); ``"..."`` is a phrase,
    ``word*`` the start of a word; parentheses group. A malformed or empty query raises a ValueError.
    """
    parts: list = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"malformed query at {at}: {text!r}")
        at = m.end()
        if m[1] or m[2]:
            parts.append(m[1] or m[2])
        elif m[5] in ("AND", "OR", "NOT"):
            parts.append(m[5])
        else:
            raw = m[3].replace('""', '"') if m[3] is not None else m[5]
            star = bool(m[4]) if m[3] is not None else raw.endswith("*")
            words = tuple(_WORD.findall(raw.lower()))
            if words:
                parts.append(Phrase(words, star))
            elif m[3] is None:
                raise ValueError(f"malformed query: {raw!r}")
    place = 0

    def peek():
        return parts[place] if place < len(parts) else None

    def take():
        nonlocal place
        place += 1
        return parts[place - 1]

    def unit():
        if peek() == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ValueError("malformed query: unclosed parenthesis")
            take()
            return inner
        if not isinstance(peek(), Phrase):
            raise ValueError(f"malformed query: {text!r}")
        return take()

    def without():
        left = unit()
        while peek() == "NOT":
            take()
            left = ("not", left, unit())
        return left

    def both():
        left = without()
        while peek() == "AND" or isinstance(peek(), Phrase) or peek() == "(":
            if peek() == "AND":
                take()
            left = ("and", left, without())
        return left

    def either():
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    tree = either()
    if peek() is not None:
        raise ValueError(f"malformed query: {text!r}")
    return tree


def _phrases(tree, inside: bool = True) -> list[tuple[Phrase, bool]]:
    """Phrases of the tree, and whether they count for the score: those under NOT don't."""
    if isinstance(tree, Phrase):
        return [(tree, inside)]
    return _phrases(tree[1], inside) + _phrases(tree[2], inside and tree[0] != "not")


def _holds(tree, found: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return found[tree] > 0
    left, right = _holds(tree[1], found), _holds(tree[2], found)
    return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right


def _hits(index: TextIndex, phrase: Phrase) -> DataFrame:
    """``(doc, tf)``: how often each document has the phrase. The filters on bucket and term reach the scan."""
    rows = index.postings
    parts = []
    for i, word in enumerate(phrase.words):
        whole = i < len(phrase.words) - 1 or not phrase.prefix
        if whole:
            term = rows.where((F.col("bucket") == _bucket(F.lit(word))) & (F.col("term") == word))
        else:
            term = rows.where(F.col("term").startswith(word))
        if len(phrase.words) == 1:
            return term.groupBy("doc").agg(F.sum("tf").alias("tf"))
        parts.append(term.select("doc", F.explode("places").alias("place")).select("doc", (F.col("place") - i).alias("place")))
    started = reduce(lambda a, b: a.join(b, ["doc", "place"]), (p.distinct() for p in parts))
    return started.groupBy("doc").agg(F.count("*").alias("tf"))


def search_index(index: TextIndex, query: str) -> DataFrame:
    """``(doc, bm25)`` of all documents that match the query; greater is better.

    Each phrase counts like a term of its own, with the number of documents that have it; statistics span all documents. Phrases under NOT filter only.
    """
    tree = parse_query(query)
    phrases = dict.fromkeys(p for p, _ in _phrases(tree))
    scored = {p for p, s in _phrases(tree) if s}
    parts = [_hits(index, p).select("doc", *(F.col("tf").cast("long").alias(f"tf{i}") if i == j else F.lit(0).cast("long").alias(f"tf{i}") for i in range(len(phrases)))) for j, p in enumerate(phrases)]
    counted = reduce(lambda a, b: a.unionAll(b), parts).groupBy("doc").agg(*(F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(phrases))))
    counted = Scratch(index.stats.sparkSession).save(counted, "counts")
    df = counted.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))))
    found = {p: F.col(f"tf{i}") for i, p in enumerate(phrases)}
    rows = counted.where(_holds(tree, found)).join(index.lengths.groupBy("doc").agg(F.sum("dl").alias("dl")), "doc")
    rows = rows.join(F.broadcast(index.stats)).join(F.broadcast(df))  # one row each
    length = BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))

    def part(i: int) -> Column:
        t, n = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(BM25_LEAST_IDF), F.log((F.col("n") - n + 0.5) / (n + 0.5)))
        return idf * t * (BM25_K1 + 1) / (t + length)

    total = reduce(lambda a, b: a + b, (part(i) for i, p in enumerate(phrases) if p in scored))
    return rows.select("doc", total.alias("bm25"))


def keyword(index: TextIndex, candidates: DataFrame, query: str, limit: int = SEARCH_LIMIT, scoring: str = "reciprocal") -> DataFrame:
    """``(thread_id, bm25, keyword_score)`` of the best ``2 * limit`` candidates; corpus statistics span all documents.

    ``scoring``: ``reciprocal`` is 1 / (1 + bm25), which falls as the match gets better; ``normalized`` is bm25 / (1 + bm25).
    """
    found = search_index(index, query).join(candidates.select(F.col("id").alias("doc")), "doc", "left_semi")
    best = found.orderBy(F.round("bm25", 9).desc(), "doc").limit(2 * limit)
    score = 1 / (1 + F.abs("bm25")) if scoring == "reciprocal" else F.abs("bm25") / (1 + F.abs("bm25"))
    return best.select(F.col("doc").alias("thread_id"), "bm25", score.alias("keyword_score"))


def semantic(vectors: DataFrame, query: list[float], limit: int = SEARCH_LIMIT, floor: float = SEMANTIC_FLOOR, skip: int | None = None) -> DataFrame:
    """``(thread_id, semantic_score)`` of the best ``2 * limit`` vectors at ``floor`` or more; best score of a thread."""
    rows = vectors if skip is None else vectors.where(F.col("id") != skip)
    score = cosine(F.col("vec"), F.array(*(F.lit(float(x)) for x in query)))
    best = rows.where(F.size("vec") == len(query)).select(F.col("id").alias("thread_id"), score.alias("s")).groupBy("thread_id").agg(F.max("s").alias("semantic_score"))
    return best.where(F.col("semantic_score") >= floor).orderBy(F.round("semantic_score", 9).desc(), "thread_id").limit(2 * limit)


def hybrid(key: DataFrame, sem: DataFrame, threads: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Sum of both scores, ties to the thread updated last, then to the greater number."""
    both = key.select("thread_id", "keyword_score").join(sem, "thread_id", "full")
    score = F.coalesce("keyword_score", F.lit(0.0)) + F.coalesce("semantic_score", F.lit(0.0))
    rows = both.join(threads.select(F.col("id").alias("thread_id"), "number", "title", "updated_at_gh"), "thread_id").withColumn("hybrid_score", score)
    return rows.orderBy(F.round("hybrid_score", 9).desc(), F.col("updated_at_gh").desc_nulls_last(), F.col("number").desc()).limit(limit)


def with_neighbors(hits: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Hits with ``neighbors``, the ``most`` strongest stored neighbours of each, open or not. ``edges``: ``(id, other_id, score)`` from either end."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "other_id"))
    best = edges.join(hits.select(F.col("thread_id").alias("id")), "id", "left_semi").withColumn("place", place).where(F.col("place") <= most)
    lists = best.groupBy(F.col("id").alias("thread_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "other_id", "score"))), lambda x: F.struct(x["other_id"].alias("thread_id"), x["score"].alias("score"))).alias("neighbors"))
    none = F.array().cast("array<struct<thread_id:bigint,score:double>>")
    return hits.join(lists, "thread_id", "left").withColumn("neighbors", F.coalesce("neighbors", none))
