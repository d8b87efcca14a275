import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import cli
from threadloom.operators import evaluate
from threadloom.operators.merge import SnapshotStore
from threadloom.plans.pipeline import Pipeline
from threadloom.sources import payloads
from threadloom.sources.providers import HashingProvider, Transient, attempt, shrunk
from threadloom.streaming.ingest import activity, merge_stream, payload_stream

NOW = "2026-01-01T00:00:00.000Z"


def issue(n, title, state="open", pr=False, updated="2026-01-01"):
    return {"id": 100 + n, "number": n, "state": state, "title": title, "body": "same words here", "html_url": f"https://x/{n}", "labels": [{"name": "bug"}], "assignees": [], "user": {"login": "a", "type": "User"}, "created_at": "2025", "updated_at": updated, **({"pull_request": {"url": "u"}} if pr else {})}


def listing(tmp_path, name, items):
    path = tmp_path / name
    path.mkdir()
    (path / "page.json").write_text("\n".join(map(json.dumps, items)))
    return f"file://{path}"


def test_payload_rows(spark, tmp_path):
    path = listing(tmp_path, "p", [issue(1, "one"), issue(2, "two", pr=True, updated="2026-02"), {"id": 9, "number": 3}])
    rows = {r.number: r for r in payloads.thread_rows(payloads.issues(spark, path), 7, NOW).collect()}
    assert rows[1].kind == "issue" and rows[2].kind == "pull_request" and json.loads(rows[1].labels_json) == [{"name": "bug"}]
    assert rows[3].title == "#3" and rows[3].state == "open" and rows[3].author_login is None
    assert [r.number for r in payloads.issues(spark, path, limit=1).collect()] == [2]
    assert {r.number for r in payloads.issues(spark, path, since="2026-01-15").collect()} == {2}
    assert payloads.one(spark, path, 1).count() == 1
    review = listing(tmp_path, "r", [{"id": 1, "state": "APPROVED", "submitted_at": "2026"}, {"id": 2, "body": "text", "state": "X"}])
    assert [(r.body, r.created_at_gh) for r in payloads.comments(spark, {"review": review}).orderBy("github_id").collect()] == [("APPROVED", "2026"), ("text", None)]


def test_refresh_close_and_reopen(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    pipe = Pipeline(spark, store)
    first = payloads.thread_rows(payloads.issues(spark, listing(tmp_path, "a", [issue(42, "cache fails badly"), issue(43, "cache fails badly", pr=True), issue(44, "unrelated matter entirely different")])), 1, NOW)
    done = pipe.refresh(1, NOW, payload=first, provider=HashingProvider(), dimensions=64)
    assert done["embed"] == 3 and pipe.embed(HashingProvider(), 64, 1, NOW) == 0
    sizes = sorted(r.member_count for r in store.read("clusters").collect())
    assert sizes == [1, 2]
    score = store.read("cluster_members").where("score_to_representative is not null").first().score_to_representative
    assert score == pytest.approx(1.0)
    assert pipe.close_thread(1, 42, NOW) is False and pipe.close_thread(1, 43, NOW) is True
    assert {r.close_reason_local for r in store.read("clusters").where("member_count = 2").collect()} == {"all_members_closed"}
    second = payloads.thread_rows(payloads.issues(spark, listing(tmp_path, "b", [issue(42, "other title"), issue(45, "brand new")])), 1, "2026-02")
    pipe.sync(second, None, 1, NOW)
    rows = {r.number: r for r in store.read("threads").collect()}
    assert rows[42].title == "other title" and rows[42].closed_at_local == NOW and rows[42].first_pulled_at == NOW and rows[42].last_pulled_at == "2026-02"
    assert len({r.id for r in rows.values()}) == 4 and rows[45].closed_at_local is None
    assert pipe.embed(HashingProvider(), 64, 1, NOW) == 1 and store.read("thread_vectors").count() == 2
    with pytest.raises(ValueError, match="at least one"):
        pipe.refresh(1, NOW, cluster=False)


def test_manual_close_stays(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    pipe = Pipeline(spark, store)
    pipe.refresh(1, NOW, payload=payloads.thread_rows(payloads.issues(spark, listing(tmp_path, "a", [issue(1, "x")])), 1, NOW), provider=HashingProvider(), dimensions=8)
    pipe.close_cluster(1, NOW)
    assert pipe.close_thread(1, 1, "later") is False and store.read("clusters").first().close_reason_local == "manual"


def test_provider_helpers():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Transient
        return ["ok"]

    assert attempt(flaky, sleep=waits.append) == ["ok"] and waits == [1, 2]
    with pytest.raises(Transient):
        attempt(lambda: (_ for _ in ()).throw(Transient()), tries=2, sleep=waits.append)
    text = "x" * 10000
    assert len(shrunk(text, "requested 10000 tokens, maximum context length is 5000")) == 4750 + 27
    assert shrunk("x" * 200, "") is None and len(shrunk(text, "?")) == 9000 + 27
    v = HashingProvider().embed(["a b", "a b", ""], 16)
    assert v[0] == v[1] and np.linalg.norm(v[0]) == pytest.approx(1) and not any(v[2])


def test_synthetic_vectors(spark):
    rows = evaluate.synthetic_vectors(spark, 5, 4).collect()
    assert len(rows) == 60 and {len(r.vec) for r in rows} == {5 * 4 + 3 + 32}
    x = {(r.source, r.id): (r.cluster, np.array(r.vec)) for r in rows}
    for (s, i), (c, v) in x.items():
        for (t, j), (d, w) in x.items():
            if s == t and i != j:
                assert (v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.82) == (c == d)


def test_evaluation(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 5)], "component long, size long")
    b = spark.createDataFrame([(1, 1), (2, 9)], "component long, size long")
    assert {tuple(r) for r in evaluate.compare_sizes(a, b, 5).collect()} == {(1, 2, 1, -1), (5, 1, 1, 0)}
    members = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(25)], "g long, o long")
    shown = evaluate.display_sample(members, "g", "o").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in shown} == {1: 25, 2: 25}
    j = spark.createDataFrame([("x", 5.0, "t", 10, 1), ("y", 3.0, "t", 10, 0)], "bucket string, coherence double, topic string, members long, outliers long")
    total = evaluate.judged(j).where("bucket is null").first()
    assert (total.clusters, total.coherence, total.topics, total.outlier_rate) == (2, 4.0, 1, 0.05)
    assert evaluate.regression(spark.createDataFrame([(100.0,), (150.0,), (120.0,)], "ms double"), 100).first().change_pct == 20.0


def test_streaming_merge(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id long, title string, updated_at string"
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def push(name, items):
        (src / name).write_text("\n".join(map(json.dumps, items)))
        stream = payload_stream(spark, f"file://{src}", schema, "updated_at")
        merge_stream(stream, store, "threads", ["id"], "updated_at", f"file://{tmp_path}/checkpoint").awaitTermination()

    push("1.json", [{"id": 1, "title": "a", "updated_at": "2026-01-01 00:00:00"}, {"id": 1, "title": "a", "updated_at": "2026-01-01 00:00:00"}, {"id": 2, "title": "b", "updated_at": "2026-01-01 00:10:00"}])
    push("2.json", [{"id": 1, "title": "A", "updated_at": "2026-01-01 01:00:00"}])
    assert {(r.id, r.title) for r in store.read("threads").collect()} == {(1, "A"), (2, "b")}
    events = spark.createDataFrame([("2026-01-01 00:05:00", "x"), ("2026-01-01 00:50:00", "x"), ("2026-01-01 01:05:00", "y")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.kind, r.n) for r in activity(events, "ts", "kind").collect()) == [("x", 2), ("y", 1)]


def test_command_line(capsys):
    assert cli.main([]) == 2 and cli.main(["query", "nope", "--root", "x"]) == 2 and cli.main(["queries"]) == 0
    assert "list_threads" in capsys.readouterr().out


def test_http(spark, tmp_path):
    spark.createDataFrame([(1, "o", "n", "o/n", None, "{}", "2026")], "id long, owner string, name string, full_name string, github_repo_id string, raw_json string, updated_at string").write.parquet(f"file://{tmp_path}/repositories.parquet")
    server = ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(spark, f"file://{tmp_path}"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: json.loads(urllib.request.urlopen(base + p).read())
    assert get("/health")["ok"] and get("/list-repositories")[0]["full_name"] == "o/n"
    for path, code in (("/nothing", 404), ("/list-repositories?limit=x", 400), ("/list-repositories?limit=0", 400), ("/list-threads", 500)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == code
    server.shutdown()


def test_repositories_are_kept_apart(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    pipe = Pipeline(spark, store, basis="title_summary")
    comment = "id long, thread_id long, github_id string, comment_type string, body string, author_login string, author_type string, is_bot int, created_at_gh string, updated_at_gh string"
    for repo in (1, 2):
        rows = payloads.thread_rows(payloads.issues(spark, listing(tmp_path, f"r{repo}", [issue(7, "cache fails badly"), issue(8, "cache fails badly")])), repo, NOW)
        done = pipe.refresh(repo, NOW, payload=rows, provider=HashingProvider(), dimensions=16)
        assert done["summarize"] == done["embed"] == 2 and pipe.current(repo, 16) == (True, True)
    assert {(r.repo_id, r.member_count) for r in store.read("clusters").collect()} == {(1, 2), (2, 2)} and store.read("clusters").select("id").distinct().count() == 2
    first = rows.limit(1)
    mine = {r.number: r.id for r in store.read("threads").where("repo_id = 2").collect()}
    hashes = {r.id: r.content_hash for r in store.read("threads").collect()}
    pipe.sync(first, spark.createDataFrame([(1, mine[first.first().number], "g", "issue", "words", "a", "User", 0, "1", None)], comment), 2, NOW)
    after = {r.id: r.content_hash for r in store.read("threads").collect()}
    assert {i for i in after if after[i] != hashes[i]} == {mine[first.first().number]} and pipe.comments().count() == 1
    pipe.sync(first, pipe.comments().limit(0), 2, NOW)
    assert pipe.comments().count() == 0 and {r.id: r.content_hash for r in store.read("threads").collect()} == hashes
    assert store.read("cursors").where("repo_id = 2").first().last_full_open_scan_started_at == NOW
    gone = pipe.reconcile_all(spark.createDataFrame([], "repo_id long, number long, state string, closed_at_gh string, updated_at_gh string, error string"), 1, "2027", NOW)
    assert gone == 2 and {(r.repo_id, r.close_reason_local) for r in store.read("clusters").collect()} == {(1, "all_members_closed"), (2, None)}
    pipe.reset_vectors(1)
    assert pipe.current(1, 16) == (False, False) and store.read("thread_vectors").count() == 2 and pipe.purge_comments(2, NOW) == 0
    assert pipe.rerun("cluster", 2, NOW)["stage"] == "cluster" and pipe.doctor()["ok"]
    with pytest.raises(LookupError):
        pipe.close_cluster(99, NOW)
    runs = store.read("runs").groupBy("id").agg(F.max_by("status", F.when(F.col("status") == "running", 0).otherwise(1)).alias("s")).collect()
    assert {r.s for r in runs} == {"completed"}
    with pytest.raises(ValueError, match="no basis"):
        Pipeline(spark, store, basis="x").embed(HashingProvider(), 16, 1, NOW)
    assert store.read("runs").where("status = 'failed'").count() == 1


def test_http_views_and_actions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    pipe = Pipeline(spark, store)
    pipe.refresh(1, NOW, payload=payloads.thread_rows(payloads.issues(spark, listing(tmp_path, "a", [issue(1, "x")])), 1, NOW), provider=HashingProvider(), dimensions=8)
    server = ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(spark, "/root/testdata/sf0.001", pipe))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: json.loads(urllib.request.urlopen(base + p).read())
    post = lambda p, b: json.loads(urllib.request.urlopen(urllib.request.Request(base + p, json.dumps(b).encode(), method="POST")).read())
    assert post("/actions/close-thread", {"repo_id": 1, "number": 1, "now": NOW}) == {"ok": True, "cluster_closed": True}
    assert post("/actions/close-cluster", {"cluster_id": 1})["ok"] and "run" in post("/actions/rerun", {"stage": "cluster", "repo_id": 1})["message"]
    for path, body, code in (("/actions/none", {}, 404), ("/actions/close-thread", {"repo_id": 1, "number": 9}, 404), ("/actions/close-thread", {}, 400), ("/actions/rerun", {"stage": "x", "repo_id": 1}, 400), ("/actions/refresh", [], 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(path, body)
        assert e.value.code == code
    if cli.os.path.isdir("/root/testdata/sf0.001"):
        assert [t["number"] for t in get("/threads?numbers=3,1,3,-2,x&repo_id=1&include_closed=true")][:1] == [3]
        assert get("/threads?numbers=0") == [] and get("/search?text=nothingatall") == []
    for path, code in (("/threads?kind=x", 400), ("/search", 400), ("/threads?nope=1", 400), ("/cluster?component=-5", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == code
    server.shutdown()
