import json
import os
import stat
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import config
from threadloom.functions.times import age_hours, months_earlier, since
from threadloom.functions.vectors import query_size, score_of_distance
from threadloom.operators import clustering, edges, merge, state, sync
from threadloom.operators.vectors import from_binary, migrated, to_binary
from threadloom.plans import experiments
from threadloom.session import Scratch, scope
from threadloom.sources import payloads
from threadloom.sources.vector_store import ExactStore
from threadloom.sources.providers import TooLong, Transient, embedded, failure, summary_ladder

THREAD = "id long, repo_id long, number long, state string, closed_at_local string, last_pulled_at string, closed_at_gh string, updated_at_gh string"
NOW = "2026-02-01"


def threads(spark):
    return spark.createDataFrame([(1, 1, 10, "open", None, "2025", None, "u"), (2, 1, 11, "open", None, None, None, "u"), (3, 1, 12, "open", None, "2026-01-15", None, "u"), (4, 1, 13, "open", "x", "2025", None, "u"), (5, 2, 10, "open", None, "2025", "old", "u"), (6, 1, 14, "closed", None, "2025", None, "u")], THREAD)


def test_scan_kinds(spark):
    rows = [(None, None, None, None), (None, "a", "b", "a"), (None, "c", "b", "c"), ("5", None, None, None), (None, "a", None, "a"), ("5", "a", "b", "a")]
    df = spark.createDataFrame(rows, "l string, s string, r string, e string")
    assert [r.k for r in df.select(sync.scan_kind(*(F.col(c) for c in "lsre")).alias("k")).collect()] == ["full", "overlapping", *["non-overlapping"] * 4]


def test_closed_listing_and_reconciliation(spark):
    listing = spark.createDataFrame([(1, 10, "closed", "t1", "v"), (1, 10, "closed", "t2", None), (1, 12, "closed", "t", "v"), (1, 13, "closed", "t", "v"), (3, 11, "closed", "t", "v"), (1, None, "closed", "t", "v")], "repo_id long, number long, state string, closed_at_gh string, updated_at_gh string")
    got = {r.id: tuple(r) for r in sync.apply_updates(threads(spark), sync.closed_updates(threads(spark), listing, "2026-01-01", NOW)).collect()}
    assert got[1] == (1, 1, 10, "closed", None, NOW, "t2", "u") and all(got[i][3] == "open" for i in (2, 3, 4, 5))
    answers = spark.createDataFrame([(1, 10, "open", None, "w", None), (1, 11, None, None, None, "500"), (2, 10, None, None, None, "Not Found")], "repo_id long, number long, state string, closed_at_gh string, updated_at_gh string, error string")
    got = {r.id: (r.state, r.closed_at_gh, r.updated_at_gh) for r in sync.reconciled_updates(threads(spark), answers, "2026-01-01", NOW).collect()}
    assert got == {1: ("open", None, "w"), 5: ("closed", "old", "u")}
    got = {r.id: (r.state, r.closed_at_gh) for r in sync.reconciled_updates(threads(spark), answers.limit(0), "2026-01-01", NOW).collect()}
    assert got == {1: ("closed", NOW), 2: ("closed", NOW), 5: ("closed", "old")}


def test_comments_are_replaced_and_purged(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id long, thread_id long")
    read = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id for r in sync.hydrate(c, spark.createDataFrame([(9, 1)], "id long, thread_id long"), read).collect()} == {9, 4}
    left, gone = sync.purge_comments(c, spark.createDataFrame([(1,), (7,)], "id long"))
    assert {r.id for r in left.collect()} == {3, 4} and {tuple(r) for r in gone.collect()} == {(1, 2), (7, 0)}


def test_cursors(spark):
    def run(i, status, at, **s):
        return (i, 1, status, at, json.dumps(s) if s else None)

    runs = spark.createDataFrame([
        run(1, "completed", "f1", crawl_started_at="c1", is_full_open_scan=True), run(2, "completed", "f2", crawl_started_at="c2", is_overlapping_open_scan=True),
        run(3, "failed", "f3", crawl_started_at="c3", is_full_open_scan=True), run(4, "completed", "f4", crawl_started_at="c4"), run(5, "completed", "f5"), (6, 1, "completed", "f6", "no json"), run(7, "completed", None, reconciled_open_close_at="r7"),
    ], "id long, repo_id long, status string, finished_at string, stats string")
    assert tuple(sync.derived_cursors(runs).first()) == (1, "c1", "f2", "f4", "r7")
    stored = spark.createDataFrame([(1, "a", None, None, None)], "repo_id long, " + ", ".join(f"{c} string" for c in sync.CURSORS))
    assert sync.cursors(stored, runs).collect() == stored.collect() and sync.cursors(stored.limit(0), runs).count() == 1


def test_state(spark):
    src = spark.createDataFrame([(1, "x", "h1"), (2, "x", "h2"), (3, "x", "h3"), (4, "x", "h4")], "thread_id long, summary_input string, content_hash string")
    known = spark.createDataFrame([(1, "h1", "v1"), (2, "other", "v1"), (3, "h3", None)], "thread_id long, content_hash string, prompt_version string")
    assert {r.thread_id for r in state.pending_summaries(src, known).collect()} == {2, 3, 4}
    ts = spark.createDataFrame([(1, 10, "t", "b"), (2, 11, "t", "b"), (3, 12, "t", "b")], "id long, number long, title string, body string")
    made = spark.createDataFrame([(1, "s"), (2, "  "), (9, "s")], "thread_id long, summary_text string")
    none = spark.createDataFrame([], "thread_id long, content_hash string")
    tasks, missing = state.workset(ts, made, none, "title_summary")
    assert [r.text for r in tasks.collect()] == ["title: t\n\nsummary: s"] and {r.number for r in missing.collect()} == {11, 12}
    with pytest.raises(ValueError, match="11, 12$"):
        state.require_summaries(missing)
    with pytest.raises(ValueError, match="…$"):
        state.require_summaries(spark.range(12).withColumnRenamed("id", "number"))
    done = state.workset(ts, None, none)[0].select("thread_id", "content_hash")
    assert state.workset(ts, None, done)[0].count() == 0 and state.workset(ts, None, done, current=False)[0].count() == 3
    want = state.desired_stamps("m")
    rows = [(1, "now", "now", "m"), (2, "now", None, "m"), (3, None, "now", "m"), (4, "now", "now", "old")]
    df = spark.createDataFrame(rows, "repo_id long, vectors_current_at string, clusters_current_at string, summary_model string").select("*", *(F.lit(v).alias(k) for k, v in want.items() if k != "summary_model"))
    assert {tuple(r) for r in state.currency(df, want).collect()} == {(1, True, True), (2, True, False), (3, False, False), (4, False, False)}


def test_neighbors_of_queries_and_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    rows = [("s", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("s", 100, [1.0, 0.0]), ("s", 101, [1.0, 0.1]), ("s", 102, None)]
    df = spark.createDataFrame(rows, "scope string, id long, vec array<double>")
    every = {(r.left_id, r.right_id) for r in edges.nearest_neighbors(df, 4, 0.1, block=16).collect()}
    assert {(100, 101), (101, 100)} <= every and not any((a < 100) != (b < 100) for a, b in every)
    some = edges.neighbors_of(df.where("id % 7 = 0 or id = 100"), df, 4, 0.1, block=16).collect()
    assert {(r.left_id, r.right_id) for r in some} == {(a, b) for a, b in every if a % 7 == 0 or a == 100}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    whole = {(r.left_id, r.right_id) for r in edges.neighbors_of(df.where("id = 3"), df, None, 0.1, block=16).collect()}
    assert whole == {(3, int(j)) for j in np.flatnonzero(u @ u[3] >= 0.1) if j != 3}
    best = edges.top_k(df.where("id = 3"), df, 2, lambda a, b: -F.abs(a[0] - b[0])).collect()
    assert {r.other_id for r in best} == set(np.argsort(np.abs(x[:, 0] - x[3, 0]))[1:3].tolist())


def test_inner_products_are_made_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 16)
    monkeypatch.setattr(edges, "STRIP", 4)
    x = np.random.default_rng(4).integers(-2, 3, size=(60, 5)).astype(float)  # many ties
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(100, [1.0, 0.0]), (101, [2.0, 0.0]), (102, None), (103, [0.0, None])], "id long, vec array<double>")
    found = edges.top_k(df.where("id % 7 = 0 or id in (100, 102, 103)"), df, 3)
    want = {(i, j, float(x[i] @ x[j])) for i in range(0, 60, 7) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-(x[i] @ x[j]), j))[:3]}
    assert {tuple(r) for r in found.collect()} == want | {(100, 101, 2.0)}
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()  # not a join that adds up each pair of vectors by itself


def test_large_graphs_go_through_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(clustering, "LOCAL", 5)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(3, 3)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 42), *range(100, 140)]], "id long")
    got = {r.id: r.component for r in clustering.connected_components(nodes, spark.createDataFrame(links, "left_id long, right_id long"), Scratch(spark)).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[41] == 41 and all(got[i] == 100 for i in range(100, 140))


def test_graphs_share_a_folder_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(clustering, "LOCAL", 5)
    scratch, kind = Scratch(spark), "left_id long, right_id long"
    nodes = spark.range(1, 42)
    made = [clustering.connected_components(nodes, spark.createDataFrame([(i, i + 1) for i in range(first, 41, 2)], kind), scratch) for first in (1, 2)]
    for first, comp in zip((1, 2), made):  # the first is read after the other's rounds
        assert {tuple(r) for r in comp.collect()} == {(i, i - (i > first and (i - first) % 2)) for i in range(1, 42)}
    x = np.random.default_rng(9).normal(size=(60, 4))
    vecs = spark.createDataFrame([(s, i, r.tolist()) for s in ("title", "body") for i, r in enumerate(x)], "source string, thread_id long, vec array<double>")
    configs = [experiments.Config(f"{f}{n}", s, f, "basic") for n, s in enumerate((("title",), ("title", "body"))) for f in ("max", "mean", "boost")]
    found = experiments.matrix(vecs, Scratch(spark), (*configs, experiments.Config("min-of-2", ("title", "body"), "min-of-2", "basic")), 2, 0.0).collect()
    assert len(found) == 7 and len({tuple(r)[3:] for r in found}) == 1  # the sources are equal, so all fusions have the same edges


def test_large_groups_come_in_batches(spark):
    rng = np.random.default_rng(11)
    links = {(int(a), int(b)): round(float(rng.random()), 3) for a, b in np.sort(rng.integers(0, 80, (300, 2)), axis=1)} | {(i, i + 1): 0.5 for i in range(79)}  # some from a node to itself
    eg = spark.createDataFrame([(a, b, v) for (a, b), v in links.items()], "left_id long, right_id long, score double").repartition(3)
    comp = spark.createDataFrame([(i, 0) for i in range(80)] + [(90, 90)], "id long, component long")
    real = [(v, a, b) for (a, b), v in links.items() if a != b]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for mode, want in (("bounded", clustering.bounded(list(range(80)), real, 7)), ("refined", clustering.refined(list(range(80)), real, 7, 0.1))):
            found = clustering.resize(comp, eg, mode, 7, 0.1)
            assert {r.id: r.component for r in found.collect()} == want | {90: 90}
            assert "FlatMapCoGroupsInArrow" not in found._jdf.queryExecution().toString()  # which holds a group and its arrays at once
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_order_and_numbers(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)], "id long, component long")
    nodes = spark.createDataFrame([(1, 50), (2, 40), (3, 1), (4, 30), (5, 60)], "id long, number long")
    assert {tuple(r) for r in clustering.ordered(comp, nodes).collect()} == {(4, 2, 1), (1, 2, 2), (3, 1, 3)}
    got = merge.numbered(spark.range(500).select((F.col("id") * 7 % 500).alias("v")).repartition(5), "n", 10, F.col("v")).collect()
    assert {(r.v, r.n) for r in got} == {(i, i + 11) for i in range(500)}


def test_matrix_searches_once(spark, monkeypatch):
    calls = []
    search = edges.nearest_neighbors
    monkeypatch.setattr(edges, "nearest_neighbors", lambda *a: calls.append(1) or search(*a))
    x = np.random.default_rng(6).normal(size=(40, 4))
    vecs = spark.createDataFrame([(s, i, r.tolist()) for s in ("title", "body") for i, r in enumerate(x)], "source string, thread_id long, vec array<double>")
    configs = [experiments.Config(m, ("title", "body"), mode=m, most=5) for m in ("basic", "bounded", "refined")]
    got = {r.name: r for r in experiments.matrix(vecs, Scratch(spark), (*configs, experiments.Config("one", ("body",), "mean", "basic")), 3, 0.0).collect()}
    assert len(calls) == 1 and len(got) == 4 and got["basic"].n_edges == got["refined"].n_edges == got["one"].n_edges
    assert got["basic"].max_size > 5 >= max(got["bounded"].max_size, got["refined"].max_size)


def test_edges_in_portions(monkeypatch):
    monkeypatch.setattr(clustering, "PORTION", 7)
    rng = np.random.default_rng(8)
    for most in (1, 3, 6, 50):
        links = [(round(float(rng.random()), 2), int(a), int(b)) for a, b in rng.integers(0, 40, (120, 2)) if a != b]
        group = {n: {n} for n in range(40)}
        for _, a, b in sorted(links, key=lambda e: (-e[0], e[1], e[2])):
            if group[a] is not group[b] and len(group[a]) + len(group[b]) <= most:
                group[a] |= group[b]
                group |= dict.fromkeys(group[b], group[a])
        assert clustering.bounded(list(range(40)), links, most) == {n: min(g) for n, g in group.items()}


def test_refine_and_matrix(spark):
    e = np.eye(4)
    rows = [(s, i, [float(v) for v in e[i // 3] + 0.01 * e[(i + 1) % 4]]) for s in ("title", "body") for i in range(6)]
    vecs = spark.createDataFrame(rows, "source string, thread_id long, vec array<double>")
    got = {r.name: (r.n_edges, r.clusters) for r in experiments.matrix(vecs, Scratch(spark), (experiments.Config("a", ("title", "body")), experiments.Config("b", ("title",), mode="refined"), experiments.Config("c", ("title",), "min-of-2", "basic")), 5, 0.8).collect()}
    assert got == {"a": (6, 2), "b": (6, 2), "c": (0, 6)}
    comp = spark.createDataFrame([(i, 0) for i in range(6)], "id long, component long")
    one = vecs.where("source = 'title'").select(F.col("thread_id").alias("id"), "vec")
    fine = clustering.refine_one(comp, one, comp.select("id", F.col("id").alias("number")), 1, 5, 0.8, Scratch(spark))
    assert {tuple(r) for r in fine.collect()} == {(i, 3 * (i // 3)) for i in range(6)}
    exact, near = (spark.createDataFrame(r, "left_id long, right_id long") for r in ([(1, 2), (1, 3)], [(1, 2), (2, 3), (3, 4)]))
    row = experiments.compared(exact, near, 10.0, 4.0).first()
    assert (row.shared, row.recall, row.change_pct, row.speedup) == (1, 0.5, 50.0, 2.5)
    judged = spark.createDataFrame([("a", 4.0, True, True), ("a", 5.0, False, True), ("b", 5.0, False, False)], "variant string, score double, boilerplate boolean, correct boolean")
    assert [tuple(r) for r in experiments.prompt_scores(judged).collect()] == [("b", 1, 5.0, 0.0, 0.0), ("a", 2, 4.5, 50.0, 100.0)]


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([(1, "[1, 2.5]", 2), (2, "[1]", 2), (3, None, 2)], "id long, v string, d int")
    packed = migrated(df, ["id"], "v", "d", 1)
    assert [(r.id, bytes(r.v)) for r in packed.collect()] == [(1, np.array([1, 2.5], "<f4").tobytes())]
    assert from_binary(packed, "v").first().v == [1.0, 2.5]
    nulls = spark.createDataFrame([(None,)], "v array<float>")
    assert from_binary(to_binary(nulls, "v"), "v").first().v is None
    assert spark.range(1).select(score_of_distance(F.lit(0.5))).first()[0] == 0.75
    assert query_size(100, 6) == {"limit": 6, "candidates": 96, "ef": 1024} and query_size(5000, 6) == {"limit": 24, "candidates": 512, "ef": 1024}


def test_retries_and_refusals():
    assert isinstance(failure(404, {}, 0), ValueError) and isinstance(failure(403, {}, 0), ValueError) and isinstance(failure(502, {}, 0), Transient)
    assert failure(429, {"Retry-After": "7"}, 0).wait == 7 and failure(403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "90"}, 60).wait == 30

    class Short:
        def embed(self, texts, dimensions):
            if any(len(t) > 4000 for t in texts):
                raise TooLong("requested 10000 tokens, maximum context length is 5000")
            return [[float(len(t))] for t in texts]

    assert embedded(Short(), ["a" * 10, "b" * 7000], 1) == [[10.0], [3325.0 + 27]]
    with pytest.raises(TooLong):
        embedded(Short(), ["b" * 7_000_000], 1, tries=2)
    good = json.dumps({k: "x" for k in ("problem_summary", "solution_summary", "maintainer_signal_summary", "dedupe_summary")})
    asked = []
    fields, usage = summary_ladder(lambda t, n: (asked.append(n), (good if n == 900 else "{", {"out": n}))[1], "t")
    assert asked == [500, 900] and usage == {"out": 1400} and len(fields) == 4
    with pytest.raises(ValueError):
        summary_ladder(lambda t, n: ("{}", {}), "t")


def test_settings(tmp_path):
    file, dot = tmp_path / "a" / "p.json", tmp_path / ".env"
    config.save_preferences(str(file), {"port": 1})
    config.save_preferences(str(file), {"embed_basis": "title_summary"})
    dot.write_text("# c\nexport THREADLOOM_STORE='s'\nTHREADLOOM_PORT=9\n")
    got = config.settings({"THREADLOOM_ROOT": "r", "THREADLOOM_EMBED_MODEL": " "}, str(file), str(dot))
    assert got["root"] == ("r", "env") and got["port"] == (1, "file") and got["store"] == ("s", "dotenv") and got["embed_basis"] == ("title_summary", "file") and got["embed_model"][1] == "default"
    assert stat.S_IMODE(os.stat(file).st_mode) == 0o600
    file.write_text("[]")
    with pytest.raises(ValueError, match="object"):
        config.settings({}, str(file))


def test_repository_payloads(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": 5, "name": "n", "owner": {"login": "o"}}\n{"id": 6, "name": "m"}\nbroken\n')
    assert [tuple(r) for r in payloads.repository_rows(spark, f"file://{tmp_path}/r.json", NOW).collect()] == [("o", "n", "o/n", "5", NOW)]


def test_scratch_is_dropped(spark):
    with scope():
        inner, kept = Scratch(spark), Scratch(spark, keep=True)
        for s in (inner, kept):
            s.save(spark.range(1), "t")
    assert not os.path.exists(inner.root.removeprefix("file://")) and os.path.exists(kept.root.removeprefix("file://"))


def test_times(spark):
    now = datetime(2026, 3, 31, 12, tzinfo=UTC)
    assert [since(t, now) for t in ("15m", "2H", "7d", "1w", "1mo", "1y", " 30s ")] == [f"{d}.000Z" for d in ("2026-03-31T11:45:00", "2026-03-31T10:00:00", "2026-03-24T12:00:00", "2026-03-24T12:00:00", "2026-03-03T12:00:00", "2025-03-31T12:00:00", "2026-03-31T11:59:30")]
    assert since("2026-01-01T00:00:00+02:00", now) == "2025-12-31T22:00:00.000Z" and since("2026-01-01", now) == "2026-01-01T00:00:00.000Z"
    for bad in ("", "5", "1q", "mo", "-1d"):
        with pytest.raises(ValueError, match="neither"):
            since(bad, now)
    df = spark.createDataFrame([("2026-03-31 12:00:00",), ("2026-01-15 00:00:00",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    got = df.select(F.date_format(months_earlier(F.col("t"), 1), "yyyy-MM-dd HH").alias("m"), age_hours(F.col("t"), F.to_timestamp(F.lit("2026-03-31 14:59:00"))).alias("a")).collect()
    assert [r.m for r in got] == ["2026-03-03 12", "2025-12-15 00", None] and [r.a for r in got] == [2, 1814, None]


def test_exact_store(spark, tmp_path):
    store = ExactStore(merge.SnapshotStore(spark, str(tmp_path)))
    rows = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [1.0, 0.1]), ("t", 3, [1.0, 0.0])], "scope string, id long, vec array<double>")
    store.upsert(rows)
    store.upsert(spark.createDataFrame([("s", 4, [0.9, 0.0]), ("s", 2, [0.0, 1.0])], "scope string, id long, vec array<double>"))
    assert [(r.left_id, r.right_id) for r in store.query(rows.where("id = 1"), 5, 0.5).collect()] == [(1, 4)]
    store.remove(spark.createDataFrame([("s", 4)], "scope string, id long"))
    assert store.query(rows.where("id = 1"), 5, 0.5).count() == 0
