import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.config import Fusion
from threadloom.functions.text import is_bot, names_of, snippet, squash, truncated
from threadloom.functions.vectors import cosine, dot, unit, usable
from threadloom.operators import clustering, edges, merge, search
from threadloom.operators.documents import canonical_documents, pending, vector_tasks
from threadloom.operators.latest import latest
from threadloom.session import Scratch


def test_latest_ties_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "c", "y"), (1, "c", "z"), (1, None, "q"), (2, None, "n"), (None, "z", "z")], "id long, at string, v string")
    assert sorted((r.id, r.v) for r in latest(df, ["id"], "at", "v").collect()) == [(1, "z"), (2, "n")]
    assert latest(df.limit(0), ["id"], "at").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("  a\r\n\t b c　", "x[bot]", None, None), (None, None, "Bot", 0), ("y" * 400, "me", "User", None)], "t string, login string, kind string, flag int")
    rows = df.select(squash(F.col("t")).alias("s"), is_bot(F.col("login"), F.col("kind"), F.col("flag")).alias("bot"), snippet(F.col("t"), 29).alias("cut"), truncated(F.col("t"), 20).alias("tr")).collect()
    assert [r.s for r in rows] == ["a b c", "", "y" * 400]
    assert [r.bot for r in rows] == [True, True, False]
    assert rows[0].cut == "a b c" and rows[1].cut is None and rows[2].cut == "y" * 28 + "…"
    assert rows[2].tr.endswith("[truncated for embedding]") and len(rows[2].tr) == 60


def test_names(spark):
    df = spark.createDataFrame([('["a", {"name": "b"}, "", {"x": 1}]',), (None,), ("nope",)], "j string")
    assert [r.n for r in df.select(names_of(F.col("j"), "name").alias("n")).collect()] == [["a", "b"], [], []]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("c"), dot(F.col("a"), F.col("b")).alias("d"), unit(F.col("a")).alias("u")).collect()
    assert [round(r.c, 6) for r in rows] == [1.0, round(1 / math.sqrt(2), 6), 0.0]
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[0].d == 25 and rows[2].u == [0.0, 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different lengths"):
        bad.select(dot(F.col("a"), F.col("b"))).collect()
    texts = ["[1,2]", " [1.0, 2e0]\n", "[1]", "[1,2,3]", "[1,null]", '[1,"2"]', "[0,0]", "[1,2] x", "", None, "{}", "[1e999,2]", "[NaN,1]"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", usable(F.col("t"), F.lit(2)).alias("v")).collect()
    assert [r.i for r in got if r.v is not None] == [0, 1]


def test_upsert_preserves_and_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", "p", None), (2, "b", "p", "x")], "k long, v string, keep string, f string")
    new = spark.createDataFrame([(2, "B", "q", None), (3, "C", "q", "y"), (None, "N", "q", None)], "k long, v string, keep string, f string")
    once = merge.upsert(base, new, ["k"], preserve=["keep"], fill=["f"])
    want = {(1, "a", "p", None), (2, "B", "p", "x"), (3, "C", "q", "y"), (None, "N", "q", None)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in merge.upsert(once, new, ["k"], preserve=["keep"], fill=["f"]).collect()} == want


def test_replace_children_and_store(spark, tmp_path):
    base = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "parent long, id long")
    new = spark.createDataFrame([(1, 12)], "parent long, id long")
    assert {tuple(r) for r in merge.replace_children(base, new, "parent").collect()} == {(1, 12), (2, 20)}
    store = merge.SnapshotStore(spark, str(tmp_path))
    assert store.version("t") is None and store.merge("t", base, ["id"]) == 1
    before = store.read("t")
    assert store.merge("t", new, ["id"]) == 2
    assert before.count() == 3 and store.read("t").count() == 4


def test_overlap_window(spark):
    rows = [("2026-03-09 13:13:00", "2026-03-09 14:13:01"), ("2026-03-09 08:00:00", "2026-03-09 14:13:01")]
    got = spark.createDataFrame(rows, "a string, b string").select(F.date_format(merge.overlap_since(F.to_timestamp("a"), F.to_timestamp("b")), "HH:mm:ss").alias("s")).collect()
    assert [r.s for r in got] == ["12:13:01", "07:13:01"]


def test_batches(spark):
    rows = [("g", i, t) for i, t in enumerate([5, 5, 5, 90, 1, 200, 1])] + [(None, 0, 1), ("h", 0, 1)]
    got = merge.batches(spark.createDataFrame(rows, "g string, o long, t long"), "g", "o", "t", 3, 100).collect()
    assert [r.batch for r in sorted((r for r in got if r.g == "g"), key=lambda r: r.o)] == [0, 0, 0, 1, 1, 2, 3]
    assert sorted(r.batch for r in got if r.g != "g") == [0, 0]


def test_canonical_document(spark):
    threads = spark.createDataFrame([(1, " T\n1 ", "B", '["x","y"]'), (2, "U", None, None)], "id long, title string, body string, labels_json string")
    comments = spark.createDataFrame(
        [(2, 1, "late", "a", "User", 0, "2020-02", None), (1, 1, "early", None, None, None, None, "2020-01"), (3, 1, "no", "k[bot]", "User", 0, "2019", None), (4, 1, None, "", "User", 0, "2021", None)],
        "id long, thread_id long, body string, author_login string, author_type string, is_bot int, created_at_gh string, updated_at_gh string",
    )
    got = {r.thread_id: r for r in canonical_documents(threads, comments).collect()}
    assert got[1].raw_text == "T 1\n\nB\n\nlabels: x, y\n\nunknown: early\n\n@a: late\n\nunknown: "
    assert got[1].dedupe_text == "title: T 1\n\nbody: B\n\nlabels: x, y\n\ndiscussion: unknown: early\n@a: late\nunknown: "
    assert got[2].raw_text == "U" and got[2].dedupe_text == "title: U"
    tasks = vector_tasks(threads)
    assert {r.text for r in tasks.collect()} == {"title: T 1\n\nbody: B", "title: U"}
    assert pending(tasks, tasks, ["thread_id"]).count() == 0 and pending(tasks, tasks.limit(0), ["thread_id"]).count() == 2


def test_neighbors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6))
    x[7] = x[3]
    rows = [("a" if i % 3 else "b", i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = edges.nearest_neighbors(spark.createDataFrame(rows, "scope string, id long, vec array<double>"), 4, 0.1, block=16).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for i in range(90):
        near = sorted((-round(float(u[i] @ u[j]), 12), j) for j in range(90) if j != i and (i % 3 > 0) == (j % 3 > 0) and u[i] @ u[j] >= 0.1)[:4]
        want |= {(i, j) for _, j in near}
    assert {(r.left_id, r.right_id) for r in got} == want
    assert edges.nearest_neighbors(spark.createDataFrame([], "scope string, id long, vec array<double>"), 4, 0.1).count() == 0


@pytest.mark.parametrize(("mode", "want"), [("max", {(1, 2): 0.9, (1, 3): 0.6}), ("mean", {(1, 2): 0.8, (1, 3): 0.6}), ("weighted", {(1, 2): (0.9 * 0.3 + 0.7 * 0.5) / 0.8, (1, 3): 0.6}), ("min-of-2", {(1, 2): 0.9}), ("boost", {(1, 2): 0.95, (1, 3): 0.6})])
def test_fusion(spark, mode, want):
    df = spark.createDataFrame([(1, 2, "title", 0.9), (1, 2, "title", 0.5), (1, 2, "dedupe_summary", 0.7), (1, 3, "other", 0.6), (2, 3, "body", 0.1)], "left_id long, right_id long, source string, score double")
    got = {(r.left_id, r.right_id): round(r.score, 6) for r in edges.fuse(df, 0.5, Fusion(mode)).collect()}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_components_and_representatives(spark):
    nodes = spark.createDataFrame([(i, 100 - i) for i in range(1, 31)], "id long, number long")
    links = [(i, i + 1, 0.9) for i in range(1, 20)] + [(25, 22, 0.8), (25, 23, 0.8), (25, 25, 1.0)]
    e = spark.createDataFrame([(min(a, b), max(a, b), s) for a, b, s in links], "left_id long, right_id long, score double")
    comp = clustering.connected_components(nodes, e, Scratch(spark))
    got = {r.id: r.component for r in comp.collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[25] == got[23] == 22 and got[30] == 30 and len(got) == 30
    reps = {r.component: (r.representative_id, r["size"]) for r in clustering.representatives(comp, e, nodes).collect()}
    assert reps[22] == (25, 3) and reps[1] == (19, 20) and reps[30] == (30, 1)
    sized = clustering.resize(comp, e, "bounded", 5, 0.02).groupBy("component").count()
    assert sized.agg(F.max("count"), F.sum("count")).first() == (5, 30)


def test_refined_and_bounded_rules():
    nodes = list(range(6))
    links = [(0.9, 0, 1), (0.9, 1, 2), (0.5, 2, 3), (0.9, 3, 4), (0.9, 4, 5)]
    assert set(clustering.refined(nodes, links, 3, 0.02).values()) == {0, 3}
    assert clustering.refined(nodes, links, 1, 0.3) == {n: n for n in nodes}
    rng = np.random.default_rng(2)
    for _ in range(50):
        many = [(float(rng.random()), int(a), int(b)) for a, b in rng.integers(0, 20, (30, 2)) if a != b]
        label = clustering.bounded(list(range(20)), many, 4)
        assert max(np.bincount(list(label.values()))) <= 4 and set(label) == set(range(20))
        free = clustering.bounded(list(range(20)), many, 99)
        assert free == clustering.refined(list(range(20)), many, 99, 0.02)


def test_bm25_against_formula(spark):
    texts = {1: "cat dog cat", 2: "dog", 3: "CAT, dog! bird bird bird", 4: None, 5: ""}
    df = spark.createDataFrame(list(texts.items()), "thread_id long, t string")
    got = {r.thread_id: r.bm25 for r in search.bm25(df, "thread_id", ["t"], ["cat", "dog"]).collect()}
    avg = (3 + 1 + 5) / 5

    def part(tf, dl, df_):
        return max(1e-6, math.log((5 - df_ + 0.5) / (df_ + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert got == pytest.approx({1: part(2, 3, 2) + part(1, 3, 3), 3: part(1, 5, 2) + part(1, 5, 3)})


def test_quality_overlap_and_sample(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, component long")
    b = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "id long, component long")
    q = clustering.quality(a).first()
    assert (q.threads, q.clusters, q.solo, q.multi, q.max_size, q.multi_member_pct, q.solo_pct, q.degenerate) == (4, 3, 2, 1, 2, 50.0, 66.67, True)
    assert {(r.a, r.b, r.shared) for r in clustering.overlap(a, b).collect()} == {(1, 2, 1), (3, 2, 1), (4, 4, 1)}
    sizes = spark.createDataFrame([(i, 100 - i if i < 50 else 1) for i in range(100)], "component long, size long")
    assert {r["stratum"]: r["count"] for r in clustering.stratified(sizes, 5, 42).groupBy("stratum").count().collect()} == {"large": 5, "small": 5, "middle": 5}
