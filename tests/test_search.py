import math
import re

import pytest

from threadloom.operators import search
from threadloom.operators.search import Phrase, parse_query

TEXTS = {1: "the cat sat", 2: "cat dog, the CAT", 3: "dog the dog cats", 4: None, 5: "", 6: "the dog cat dog", 7: "naïve Кот cat"}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame([*TEXTS.items(), (None, "cat")], "id long, t string")
    return search.build_index(df, "id", ["t"], f"file://{tmp_path_factory.mktemp('index')}")


def test_grammar():
    a, b, c = (Phrase((w,)) for w in "abc")
    assert parse_query("a b") == parse_query("a AND b") == ("and", a, b)
    assert parse_query("a b OR c") == ("or", ("and", a, b), c) and parse_query("a (b OR c)") == ("and", a, ("or", b, c))
    assert parse_query("a NOT b c") == ("and", ("not", a, b), c)
    assert parse_query('"a B"* c*') == ("and", Phrase(("a", "b"), True), Phrase(("c",), True))
    assert parse_query("x-y") == Phrase(("x", "y")) and parse_query("or") == Phrase(("or",))
    for bad in ("", "  ", "a OR", "NOT a", "(a", "a)", "AND", '"open', "+"):
        with pytest.raises(ValueError, match="malformed"):
            parse_query(bad)


def brute(query):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in TEXTS.items()}
    avg = sum(map(len, words.values())) / len(words)

    def tf(p, w):
        n = len(p.words)
        return sum(all(w[i + k].startswith(p.words[k]) if p.prefix and k == n - 1 else w[i + k] == p.words[k] for k in range(n)) for i in range(len(w) - n + 1))

    def holds(t, w):
        if isinstance(t, Phrase):
            return tf(t, w) > 0
        x, y = holds(t[1], w), holds(t[2], w)
        return {"and": x and y, "or": x or y, "not": x and not y}[t[0]]

    def scored(t):
        return {t} if isinstance(t, Phrase) else scored(t[1]) | (scored(t[2]) if t[0] != "not" else set())

    tree = parse_query(query)
    out = {}
    for i, w in words.items():
        if holds(tree, w):
            out[i] = 0.0
            for p in scored(tree):
                df = sum(tf(p, x) > 0 for x in words.values())
                idf = max(1e-6, math.log((len(words) - df + 0.5) / (df + 0.5)))
                out[i] += idf * tf(p, w) * 2.2 / (tf(p, w) + 1.2 * (0.25 + 0.75 * len(w) / avg))
    return out


@pytest.mark.parametrize("query", ["cat", "cat dog", "cat OR sat", "the NOT dog", '"the dog"', '"the ca"*', "ca* dog", "кот OR naïve", "(cat OR dog) NOT sat", "nothing"])
def test_index_against_brute_force(index, query):
    got = {r.doc: r.bm25 for r in search.search_index(index, query).collect()}
    assert got == pytest.approx(brute(query))


def test_terms_are_pruned(index):
    plan = search._hits(index, Phrase(("cat",)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,cat)" in plan


def test_candidates_scoring_and_neighbors(spark, index):
    rows = spark.createDataFrame([(i,) for i in (1, 2, 6)], "id long")
    worse, better = (search.keyword(index, rows, "cat", 1, s).collect() for s in ("reciprocal", "normalized"))
    assert len(worse) == 2 and [r.thread_id for r in worse] == [r.thread_id for r in better] and all(r.keyword_score + s.keyword_score == pytest.approx(1) for r, s in zip(worse, better))
    edges = spark.createDataFrame([(1, 9, 0.5), (1, 8, 0.9), (1, 7, 0.9), (3, 1, 1.0)], "id long, other_id long, score double")
    got = {r.thread_id: [(n.thread_id, n.score) for n in r.neighbors] for r in search.with_neighbors(spark.createDataFrame([(1,), (2,)], "thread_id long"), edges, 2).collect()}
    assert got == {1: [(7, 0.9), (8, 0.9)], 2: []}
