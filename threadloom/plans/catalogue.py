"""Queries of the engine's own operators over the corpus tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.config import BATCH_ITEMS, BATCH_TOKENS, SNIPPET_CHARS, Fusion
from threadloom.functions.text import SPACE_CODES, estimated_tokens, is_bot, names_of, snippet, truncated
from threadloom.functions.vectors import norm, unit
from threadloom.operators import clustering, edges, evaluate, merge, search
from threadloom.operators.documents import canonical_documents, pending, summary_sources, vector_tasks
from threadloom.plans import model
from threadloom.session import Scratch, tune
from threadloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WS = "[" + "".join("\\x{%X}" % c for c in SPACE_CODES) + "]+"
_BASE = f"""
WITH RECURSIVE th AS (SELECT * FROM threads WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1),
cm AS (SELECT * FROM comments WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at_gh DESC NULLS LAST, body DESC NULLS LAST) = 1),
rp AS (SELECT * FROM repositories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, raw_json DESC NULLS LAST) = 1),
lab AS (SELECT id, list_filter(list_transform(coalesce(json_extract_string(labels_json, '$[*]'), []), lambda x: CASE WHEN x LIKE '{{%' THEN json_extract_string(x, '$.name') ELSE x END), lambda x: x IS NOT NULL AND x <> '') AS labels FROM th),
sq AS (SELECT th.id, trim(regexp_replace(coalesce(title, ''), '{_WS}', ' ', 'g')) AS t, trim(regexp_replace(coalesce(body, ''), '{_WS}', ' ', 'g')) AS b, array_to_string(labels, ', ') AS l FROM th JOIN lab USING (id)),
human AS (SELECT thread_id, id, coalesce(created_at_gh, updated_at_gh) AS said, coalesce('@' || nullif(author_login, ''), 'unknown') AS who, trim(regexp_replace(coalesce(body, ''), '{_WS}', ' ', 'g')) AS txt FROM cm
    WHERE NOT (coalesce(is_bot, 0) = 1 OR lower(coalesce(author_type, '')) = 'bot' OR suffix(lower(coalesce(author_login, '')), '[bot]') OR contains(lower(coalesce(author_login, '')), 'renovate') OR contains(lower(coalesce(author_login, '')), 'dependabot'))),
vec AS (SELECT thread_id AS id, v FROM (SELECT thread_id, updated_at, vector_json, dimensions, TRY_CAST(TRY_CAST(vector_json AS JSON) AS DOUBLE[]) AS v FROM thread_vectors WHERE model = 'trellis-embed-l' AND thread_id IS NOT NULL)
    WHERE len(v) = dimensions AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
    QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY updated_at DESC NULLS LAST, vector_json DESC) = 1),
svec AS (SELECT source_kind AS source, thread_id AS id, v FROM (SELECT source_kind, thread_id, updated_at, embedding_json, dimensions, TRY_CAST(TRY_CAST(embedding_json AS JSON) AS DOUBLE[]) AS v FROM document_embeddings WHERE model = 'trellis-embed-l' AND thread_id IS NOT NULL AND source_kind IS NOT NULL)
    WHERE len(v) = dimensions AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
    QUALIFY row_number() OVER (PARTITION BY source_kind, thread_id ORDER BY updated_at DESC NULLS LAST, embedding_json DESC) = 1),
opn AS (SELECT * FROM th WHERE state = 'open' AND closed_at_local IS NULL),
run AS (SELECT repo_id, max(cluster_run_id) AS cluster_run_id FROM similarity_edges WHERE repo_id IS NOT NULL GROUP BY 1),
good AS (SELECT repo_id, cluster_run_id, least(left_thread_id, right_thread_id) AS left_id, greatest(left_thread_id, right_thread_id) AS right_id, score FROM similarity_edges WHERE score >= 0.78 AND score <= 1 AND left_thread_id <> right_thread_id AND repo_id IS NOT NULL),
eg AS (SELECT repo_id, left_id, right_id, max(score) AS score FROM good JOIN run USING (repo_id, cluster_run_id) GROUP BY ALL),
allg AS (SELECT repo_id, left_id, right_id, max(score) AS score FROM good GROUP BY ALL),
bw AS (SELECT left_id AS id, right_id AS other_id, score FROM eg UNION ALL SELECT right_id, left_id, score FROM eg),
"""
_REACH = """
reach(id, r) AS (SELECT id, id FROM th UNION SELECT bw.other_id, reach.r FROM reach JOIN bw ON bw.id = reach.id),
comp AS (SELECT th.id, min(r) AS component FROM th JOIN reach USING (id) GROUP BY 1),
deg AS (SELECT id, count(*) AS degree FROM (SELECT left_id AS id FROM eg UNION ALL SELECT right_id FROM eg) GROUP BY 1),
rep AS (SELECT component, arg_min(id, {'d': -coalesce(degree, 0), 'n': number, 'i': id}) AS representative_id, count(*) AS size FROM comp JOIN th USING (id) LEFT JOIN deg USING (id) GROUP BY 1),
"""


def query(oracle: str | None = None, reach: bool = False, also: str = ""):
    """Register a query under its function's name, with the end of its SQL (after the shared tables and those of ``also``)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return f(tune(spark), root)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = _BASE + (_REACH if reach else "") + also + "fin AS (SELECT 1) " + oracle
        return run

    return add


# lists and statistics


@query("SELECT id, owner, name, full_name, github_repo_id, updated_at FROM rp")
def list_repositories(spark, root):
    return model.repositories(spark, root).select("id", "owner", "name", "full_name", "github_repo_id", "updated_at").orderBy("full_name")


_THREAD = ["id", "repo_id", "number", "kind", "state", "title", "author_login", "html_url", "updated_at_gh"]


@query("SELECT id, repo_id, number, kind, state, title, author_login, html_url, updated_at_gh, array_to_string(labels, '|') AS labels FROM opn JOIN lab USING (id)")
def list_threads(spark, root):
    """Open threads, newest first."""
    rows = model.threads(spark, root).where(model.is_open())
    return rows.select(*_THREAD, F.array_join(names_of(F.col("labels_json"), "name"), "|").alias("labels")).orderBy(F.col("updated_at_gh").desc_nulls_last(), F.col("number").desc())


@query("SELECT id, repo_id, number, kind, state, title, author_login, html_url, updated_at_gh, (state <> 'open' OR closed_at_local IS NOT NULL) AS is_closed, closed_at_gh, closed_at_local, close_reason_local FROM th")
def list_threads_closed(spark, root):
    """All threads with their close state."""
    return model.threads(spark, root).select(*_THREAD, model.is_closed().alias("is_closed"), "closed_at_gh", "closed_at_local", "close_reason_local")


@query("SELECT id, number, kind, title, w.place FROM th JOIN (SELECT unnest([7, 3, 12, 5, 1]) AS number, unnest([0, 1, 2, 3, 4]) AS place) w USING (number) WHERE repo_id = 1")
def threads_by_number(spark, root):
    """Threads of one repository in the requested order."""
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate([7, 3, 12, 5, 1])], "number long, place int")
    return model.threads(spark, root).where("repo_id = 1").join(F.broadcast(wanted), "number").select("id", "number", "kind", "title", "place").orderBy("place")


@query("""SELECT repo_id, CAST(count(*) FILTER (WHERE kind = 'issue') AS BIGINT) AS open_issues, CAST(count(*) FILTER (WHERE kind = 'pull_request') AS BIGINT) AS open_pull_requests, max(last_pulled_at) AS last_pulled_at,
    count(*) - count(vec.id) AS without_vector, max(run.cluster_run_id) AS latest_run FROM opn LEFT JOIN vec USING (id) LEFT JOIN run USING (repo_id) GROUP BY 1""")
def repo_stats(spark, root):
    """Open counts by kind, last pull, threads without a usable vector, and the latest run of every repository."""
    rows = model.threads(spark, root).where(model.is_open()).select("id", "repo_id", "kind", "last_pulled_at")
    known = model.vectors(spark, root).select("id", F.lit(True).alias("has"))
    kind = lambda k: F.count_if(F.col("kind") == k)
    per = rows.join(known, "id", "left").groupBy("repo_id").agg(kind("issue").alias("open_issues"), kind("pull_request").alias("open_pull_requests"), F.max("last_pulled_at").alias("last_pulled_at"), F.count_if(F.col("has").isNull()).alias("without_vector"))
    return per.join(model.latest_runs(spark, root).withColumnRenamed("cluster_run_id", "latest_run"), "repo_id", "left")


@query("SELECT * FROM run")
def latest_completed_run(spark, root):
    return model.latest_runs(spark, root)


@query("""SELECT lower(author_login) AS author, count(*) AS threads, count(*) FILTER (WHERE state = 'open' AND closed_at_local IS NULL) AS open_threads, max(updated_at_gh) AS latest FROM th WHERE trim(author_login) <> '' GROUP BY 1""")
def author_threads(spark, root):
    """Threads of every author, whatever the case of the login."""
    rows = model.threads(spark, root).where(F.trim("author_login") != "")
    return rows.groupBy(F.lower("author_login").alias("author")).agg(F.count("*").alias("threads"), F.count_if(model.is_open()).alias("open_threads"), F.max("updated_at_gh").alias("latest"))


@query("""SELECT bw.id AS thread_id, arg_max(bw.other_id, {'s': bw.score, 'i': -bw.other_id}) AS match_id, max(bw.score) AS score FROM bw JOIN th a ON a.id = bw.id JOIN th b ON b.id = bw.other_id WHERE lower(a.author_login) = lower(b.author_login) GROUP BY 1""")
def author_strongest_match(spark, root):
    """Each thread's strongest stored edge to a thread of the same author."""
    who = model.threads(spark, root).select("id", F.lower("author_login").alias("author"))
    both = edges.both_ways(model.stored_edges(spark, root)).join(who, "id").join(who.select(F.col("id").alias("other_id"), F.col("author").alias("other")), "other_id").where("author = other")
    return both.groupBy(F.col("id").alias("thread_id")).agg(F.max_by("other_id", F.struct("score", -F.col("other_id"))).alias("match_id"), F.max("score").alias("score"))


@query("""SELECT thread_id, count(*) AS comments, count(*) FILTER (WHERE coalesce(is_bot, 0) = 1 OR lower(coalesce(author_type, '')) = 'bot' OR suffix(lower(coalesce(author_login, '')), '[bot]') OR contains(lower(coalesce(author_login, '')), 'renovate') OR contains(lower(coalesce(author_login, '')), 'dependabot')) AS bots FROM cm GROUP BY 1""")
def comments_bot_filter(spark, root):
    bot = is_bot(F.col("author_login"), F.col("author_type"), F.col("is_bot"))
    return model.comments(spark, root).groupBy("thread_id").agg(F.count("*").alias("comments"), F.count_if(bot).alias("bots"))


# ingest


@query("""SELECT id AS thread_id, CASE WHEN json_exists(raw, '$.pull_request') AND coalesce(json_type(raw, '$.pull_request'), 'NULL') <> 'NULL' THEN 'pull_request' ELSE 'issue' END AS kind, CAST(json_extract_string(raw, '$.number') AS BIGINT) AS number, json_extract_string(raw, '$.user.login') AS author_login, json_extract_string(raw, '$.user.type') AS author_type
    FROM (SELECT id, raw_json AS raw FROM threads WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, raw_json DESC NULLS LAST) = 1) WHERE json_valid(raw) AND raw LIKE '%{%' AND ltrim(raw, chr(32) || chr(9) || chr(10) || chr(13)) LIKE '{%'""")
def payload_fields(spark, root):
    """Kind, number and author of every thread's payload that is an object."""
    from threadloom.operators.latest import latest

    rows = latest(table(spark, root, "threads").select("id", "updated_at", "raw_json"), ["id"], "updated_at", "raw_json")
    v = F.try_parse_json("raw_json")
    rows = rows.select("id", v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    pr = F.schema_of_variant(F.variant_get("v", "$.pull_request", "variant"))
    kind = F.when(pr.isNotNull() & (pr != "VOID"), "pull_request").otherwise("issue")
    return rows.select(F.col("id").alias("thread_id"), kind.alias("kind"), get("$.number", "long").alias("number"), get("$.user.login", "string").alias("author_login"), get("$.user.type", "string").alias("author_type"))


@query("SELECT id, u.label AS label FROM lab, unnest(labels) AS u(label)")
def label_extraction(spark, root):
    return model.threads(spark, root).select("id", F.explode(names_of(F.col("labels_json"), "name")).alias("label"))


@query("""SELECT id, u.x AS assignee FROM (SELECT id, list_filter(list_transform(coalesce(json_extract_string(assignees_json, '$[*]'), []), lambda x: CASE WHEN x LIKE '{%' THEN json_extract_string(x, '$.login') ELSE x END), lambda x: x IS NOT NULL AND x <> '') AS a FROM th), unnest(a) AS u(x)""")
def assignee_extraction(spark, root):
    return model.threads(spark, root).select("id", F.explode(names_of(F.col("assignees_json"), "login")).alias("assignee"))


@query("""SELECT n.repo_id, n.kind, n.number, n.title, n.state, o.first_pulled_at, n.last_pulled_at, o.closed_at_local, o.close_reason_local, n.content_hash FROM
    (SELECT * FROM threads QUALIFY row_number() OVER (PARTITION BY repo_id, kind, number ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1) n JOIN
    (SELECT * FROM threads QUALIFY row_number() OVER (PARTITION BY repo_id, kind, number ORDER BY updated_at ASC NULLS LAST, content_hash ASC NULLS LAST) = 1) o USING (repo_id, kind, number)""")
def upsert_threads(spark, root):
    """The first snapshot of every thread, written over by its last; pull start and local close are preserved."""
    from threadloom.operators.latest import latest

    rows = table(spark, root, "threads").drop("raw_json", "body")
    key = ["repo_id", "kind", "number"]
    cols = [*key, "title", "state", "first_pulled_at", "last_pulled_at", "closed_at_local", "close_reason_local", "content_hash"]
    base = merge.first_snapshot(rows, key, "updated_at").select(*cols)
    incoming = latest(rows, key, "updated_at", "content_hash").select(*cols)
    return merge.upsert(base, incoming, key, preserve=["first_pulled_at", "closed_at_local", "close_reason_local"])


@query("SELECT id, repo_id, number, last_pulled_at FROM opn WHERE last_pulled_at IS NULL OR last_pulled_at < '2025-01-01T00:00:00.000Z'")
def stale_open_threads(spark, root):
    return merge.stale_open(model.threads(spark, root), "2025-01-01T00:00:00.000Z").select("id", "repo_id", "number", "last_pulled_at")


@query("""SELECT repo_id, strftime(ts - to_hours(CAST(greatest(2, ceil(epoch_us(ts - ref) / 3600000000.0)) AS INTEGER)), '%Y-%m-%d %H:%M:%S.%g') AS since FROM
    (SELECT repo_id, max(strptime(last_pulled_at, '%Y-%m-%dT%H:%M:%S.%gZ')) AS ts, min(strptime(last_pulled_at, '%Y-%m-%dT%H:%M:%S.%gZ')) AS ref FROM th WHERE last_pulled_at IS NOT NULL GROUP BY 1)""")
def incremental_since(spark, root):
    """Start of the next overlapping scan of every repository."""
    at = F.try_to_timestamp("last_pulled_at")  # any ISO form
    per = model.threads(spark, root).where(at.isNotNull()).groupBy("repo_id").agg(F.max(at).alias("ts"), F.min(at).alias("ref"))
    return per.select("repo_id", F.date_format(merge.overlap_since(F.col("ref"), F.col("ts")), "yyyy-MM-dd HH:mm:ss.SSS").alias("since"))


@query("""SELECT repo_id, arg_max(first_pulled_at, updated_at) FILTER (WHERE first_pulled_at IS NOT NULL) AS first_pulled_at, arg_max(last_pulled_at, updated_at) FILTER (WHERE last_pulled_at IS NOT NULL) AS last_pulled_at, arg_max(closed_at_gh, updated_at) FILTER (WHERE closed_at_gh IS NOT NULL) AS closed_at_gh FROM th GROUP BY 1""")
def cursor_backfill(spark, root):
    """Per repository the newest known value of each cursor."""
    return merge.newest_values(model.threads(spark, root), "repo_id", "updated_at", ["first_pulled_at", "last_pulled_at", "closed_at_gh"])


# documents

_RAW = "concat_ws(chr(10) || chr(10), nullif(t, ''), nullif(b, ''), 'labels: ' || nullif(l, ''), r)"
_DED = "concat_ws(chr(10) || chr(10), 'title: ' || t, 'body: ' || nullif(b, ''), 'labels: ' || nullif(l, ''), 'discussion: ' || d)"
_TALK = "(SELECT thread_id AS id, string_agg(who || ': ' || txt, chr(10) || chr(10) ORDER BY said NULLS FIRST, human.id) AS r, string_agg(who || ': ' || txt, chr(10) ORDER BY said NULLS FIRST, human.id) AS d FROM human GROUP BY 1)"


@query(f"SELECT id AS thread_id, sha256({_RAW}) AS raw_hash, sha256({_RAW} || chr(10) || '---' || chr(10) || {_DED}) AS content_hash FROM sq LEFT JOIN {_TALK} USING (id)")
def canonical_document_hash(spark, root):
    found = canonical_documents(model.threads(spark, root), model.comments(spark, root))
    return found.select("thread_id", F.sha2("raw_text", 256).alias("raw_hash"), "content_hash")


@query(f"SELECT id AS thread_id, {_DED} AS dedupe_text FROM sq LEFT JOIN {_TALK} USING (id)")
def dedupe_text(spark, root):
    return canonical_documents(model.threads(spark, root), model.comments(spark, root)).select("thread_id", "dedupe_text")


@query("""SELECT sq.id AS thread_id, sha256('summary:v1:with-comments' || chr(10) || concat_ws(chr(10) || chr(10), 'title: ' || t, 'body: ' || nullif(b, ''), 'labels: ' || nullif(l, ''), 'discussion:' || chr(10) || d)) AS content_hash
    FROM sq LEFT JOIN (SELECT thread_id AS id, string_agg(who || ': ' || txt, chr(10) ORDER BY said NULLS FIRST, human.id) AS d FROM human WHERE txt <> '' GROUP BY 1) USING (id)""")
def summary_source_hash(spark, root):
    return summary_sources(model.threads(spark, root), model.comments(spark, root), True).select("thread_id", "content_hash")


_CUT = f"CASE WHEN length(w) > 21000 THEN regexp_replace(substr(w, 1, 21000 - 27), '{_WS}$', '') || chr(10) || chr(10) || '[truncated for embedding]' ELSE w END"
_TASK = f"(SELECT id, {_CUT} AS x, length(w) > 21000 AS was FROM (SELECT id, concat_ws(chr(10) || chr(10), 'title: ' || t, 'body: ' || nullif(b, '')) AS w FROM sq))"


@query(f"SELECT id AS thread_id, greatest(1, CAST(ceil(length(x) / 3.0) AS BIGINT)) AS estimated_tokens, was AS was_truncated, sha256('embedding:vectorlite-1024-v1:title_original:text-embedding-3-large:1024' || chr(10) || x) AS content_hash FROM {_TASK}")
def active_vector_task(spark, root):
    return vector_tasks(model.threads(spark, root)).drop("text")


@query(f"SELECT doc_id, sha256(CASE WHEN length(raw_text) > 6000 THEN regexp_replace(substr(raw_text, 1, 6000 - 27), '{_WS}$', '') || chr(10) || chr(10) || '[truncated for embedding]' ELSE raw_text END) AS cut FROM documents WHERE raw_text IS NOT NULL")
def embedding_truncation(spark, root):
    return table(spark, root, "documents").where("raw_text is not null").select("doc_id", F.sha2(truncated(F.col("raw_text"), 2000), 256).alias("cut"))


@query("SELECT doc_id, greatest(1, CAST(ceil(length(text) / 3.0) AS BIGINT)) AS estimated_tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", estimated_tokens(F.col("text")).alias("estimated_tokens"))


@query(f"SELECT id, nullif(CASE WHEN length(b) <= {SNIPPET_CHARS} THEN b ELSE regexp_replace(substr(b, 1, {SNIPPET_CHARS - 1}), '{_WS}$', '') || chr(8230) END, '') AS snippet FROM sq")
def body_snippet(spark, root):
    return model.threads(spark, root).select("id", snippet(F.col("body")).alias("snippet"))


@query("""SELECT th.id AS thread_id FROM th LEFT JOIN (SELECT thread_id, content_hash AS h FROM thread_vectors WHERE model = 'trellis-embed-l' AND thread_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1) s ON s.thread_id = th.id
    WHERE state = 'open' AND closed_at_local IS NULL AND content_hash IS DISTINCT FROM h""")
def pending_vectors(spark, root):
    """Open threads whose stored vector is missing or was made from other content."""
    from threadloom.operators.latest import latest

    stored = latest(table(spark, root, "thread_vectors").where(F.col("model") == model.MODEL).select("thread_id", "updated_at", "content_hash"), ["thread_id"], "updated_at", "content_hash")
    tasks = model.threads(spark, root).where(model.is_open()).select(F.col("id").alias("thread_id"), "content_hash")
    return pending(tasks, stored, ["thread_id"]).select("thread_id")


@query("""SELECT th.id AS thread_id, k.source AS source FROM th, (SELECT unnest(['title', 'body', 'dedupe_summary']) AS source) k LEFT JOIN (SELECT thread_id, source_kind, content_hash AS h FROM document_embeddings WHERE model = 'trellis-embed-l' AND thread_id IS NOT NULL AND source_kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_kind, thread_id ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1) s
    ON s.thread_id = th.id AND s.source_kind = k.source WHERE th.state = 'open' AND h IS NULL""")
def pendingsummaries(spark, root):
    """Source texts of open threads that have no embedding."""
    from threadloom.operators.latest import latest

    stored = latest(table(spark, root, "document_embeddings").where(F.col("model") == model.MODEL).select(F.col("source_kind").alias("source"), "thread_id", "updated_at", "content_hash"), ["source", "thread_id"], "updated_at", "content_hash")
    tasks = model.threads(spark, root).where("state = 'open'").select(F.col("id").alias("thread_id"), F.explode(F.array(*map(F.lit, ("title", "body", "dedupe_summary")))).alias("source"))
    return tasks.join(stored.where("content_hash is not null").select("source", "thread_id"), ["source", "thread_id"], "left_anti").select("thread_id", "source")


@query("SELECT repo_id, thread_id, estimated_tokens, batch FROM fold", also=f"""
tk AS (SELECT th.repo_id, x.id AS thread_id, greatest(1, CAST(ceil(length(x.x) / 3.0) AS BIGINT)) AS estimated_tokens, row_number() OVER (PARTITION BY th.repo_id ORDER BY x.id) AS rn FROM {_TASK} x JOIN th ON th.id = x.id),
fold AS (SELECT repo_id, thread_id, estimated_tokens, rn, 1 AS n, estimated_tokens AS total, 0 AS batch FROM tk WHERE rn = 1
    UNION ALL SELECT tk.repo_id, tk.thread_id, tk.estimated_tokens, tk.rn, CASE WHEN f.n >= 8 OR f.total + tk.estimated_tokens > 250000 THEN 1 ELSE f.n + 1 END,
        CASE WHEN f.n >= 8 OR f.total + tk.estimated_tokens > 250000 THEN tk.estimated_tokens ELSE f.total + tk.estimated_tokens END, CASE WHEN f.n >= 8 OR f.total + tk.estimated_tokens > 250000 THEN f.batch + 1 ELSE f.batch END
    FROM fold f JOIN tk ON tk.repo_id = f.repo_id AND tk.rn = f.rn + 1),
""")
def batch_chunks(spark, root):
    """Embedding requests: batches of tasks by count and tokens, in order of the thread."""
    ts = model.threads(spark, root)
    tasks = vector_tasks(ts).join(ts.select(F.col("id").alias("thread_id"), "repo_id"), "thread_id")
    return merge.batches(tasks.select("repo_id", "thread_id", "estimated_tokens"), "repo_id", "thread_id", "estimated_tokens", BATCH_ITEMS, BATCH_TOKENS)


# vectors and edges

_KNN = """(SELECT * FROM (SELECT a.repo_id AS repo_id, a.id AS left_id, b.id AS right_id, list_cosine_similarity(va.v, vb.v) AS score FROM opn a JOIN vec va ON va.id = a.id JOIN opn b ON b.repo_id = a.repo_id AND b.id <> a.id JOIN vec vb ON vb.id = b.id AND len(va.v) = len(vb.v)) WHERE score >= 0.78
    QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY round(score, 12) DESC, right_id) <= 6)"""


@query(f"SELECT left_id, right_id, round(score, 6) AS score FROM {_KNN}")
def cosine_pairs_topk(spark, root):
    """Each open thread's 6 nearest of its repository at 0.78 or more."""
    near = edges.nearest_neighbors(model.scoped(model.vectors(spark, root), model.threads(spark, root)), 6, 0.78)
    return near.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query(f"SELECT least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id, round(max(score), 6) AS score FROM {_KNN} GROUP BY 1, 2")
def knn_edges_union(spark, root):
    found = edges.knn_edges(model.scoped(model.vectors(spark, root), model.threads(spark, root)))
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query(f"SELECT left_id, right_id, round(max(score), 6) AS score FROM {_KNN} WHERE left_id < right_id GROUP BY 1, 2")
def knn_edges_lower_id(spark, root):
    found = edges.knn_edges(model.scoped(model.vectors(spark, root), model.threads(spark, root)), policy="lower_id_owner")
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("SELECT repo_id, left_id, right_id, score FROM allg")
def edges_canonical_max(spark, root):
    return model.stored_edges(spark, root, latest_only=False)


@query("""SELECT * FROM (SELECT q.id AS thread_id, b.id AS neighbor_id, round(list_cosine_similarity(vq.v, vb.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(vq.v, vb.v), 9) DESC, b.id) AS place
    FROM opn q JOIN vec vq ON vq.id = q.id JOIN opn b ON b.repo_id = q.repo_id AND b.id <> q.id JOIN vec vb ON vb.id = b.id AND len(vb.v) = len(vq.v) WHERE q.id % 50 = 0 AND list_cosine_similarity(vq.v, vb.v) >= 0.2) WHERE place <= 10""")
def neighbors_of_thread(spark, root):
    """The 10 nearest open threads of the repository, for every thread whose id is divisible by 50."""
    rows = model.scoped(model.vectors(spark, root), model.threads(spark, root))
    near = edges.neighbors_of(rows.where("id % 50 = 0"), rows, 10, 0.2)
    place = F.row_number().over(Window.partitionBy("left_id").orderBy(F.round("score", 9).desc(), "right_id"))
    return near.select(F.col("left_id").alias("thread_id"), F.col("right_id").alias("neighbor_id"), F.round("score", 6).alias("score"), place.cast("long").alias("place"))


_SRC = """(SELECT a.repo_id AS repo_id, va.source AS source, a.id AS left_id, b.id AS right_id, list_cosine_similarity(va.v, vb.v) AS score FROM opn a JOIN svec va ON va.id = a.id JOIN opn b ON b.repo_id = a.repo_id AND b.id <> a.id JOIN svec vb ON vb.id = b.id AND vb.source = va.source AND len(va.v) = len(vb.v))"""
_SKNN = f"(SELECT * FROM {_SRC} WHERE score >= -0.3 QUALIFY row_number() OVER (PARTITION BY source, left_id ORDER BY round(score, 12) DESC, right_id) <= 25)"
_PER = f"(SELECT least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id, source, max(score) AS score, CASE source WHEN 'dedupe_summary' THEN 0.5 WHEN 'title' THEN 0.3 WHEN 'body' THEN 0.2 ELSE 0.1 END AS w FROM {_SKNN} GROUP BY 1, 2, 3)"


def _source_edges(spark, root):
    scope = model.scoped(model.source_vectors(spark, root), model.threads(spark, root), "source")
    return edges.nearest_neighbors(scope, 25, -0.3).select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), F.substring_index("scope", "/", -1).alias("source"), "score")


@query(f"SELECT left_id AS thread_id, right_id AS neighbor_id, round(max(score), 6) AS score FROM {_SRC} WHERE left_id % 50 = 0 AND score >= 0.2 GROUP BY 1, 2")
def neighbors_multi_source_max(spark, root):
    """Similar threads over all source kinds, by the best kind, for every thread whose id is divisible by 50."""
    scope = model.scoped(model.source_vectors(spark, root), model.threads(spark, root), "source")
    near = edges.neighbors_of(scope.where("id % 50 = 0"), scope, None, 0.2)
    return near.groupBy(F.col("left_id").alias("thread_id"), F.col("right_id").alias("neighbor_id")).agg(F.round(F.max("score"), 6).alias("score"))


def _fusion(name: str, mode: str, score: str) -> None:
    sql = f"SELECT left_id, right_id, round(s, 6) AS score, sources FROM (SELECT left_id, right_id, {score} AS s, string_agg(source, ',' ORDER BY source) AS sources FROM {_PER} GROUP BY 1, 2) WHERE s >= 0.0"

    def run(spark, root):
        return edges.fuse(_source_edges(spark, root), 0.0, Fusion(mode)).withColumn("score", F.round("score", 6))

    run.__name__, run.__doc__ = name, f"Edges of three sources, each thread's 25 nearest of each, fused by {mode}: sources agree on few pairs, so the floors are low."
    query(sql)(run)


_fusion("fuse_max", "max", "max(score)")
_fusion("fuse_mean", "mean", "avg(score)")
_fusion("fuse_weighted", "weighted", "sum(score * w) / sum(w)")
_fusion("fuse_min_of_2", "min-of-2", "CASE WHEN count(*) >= 2 THEN max(score) END")
_fusion("fuse_boost", "boost", "least(1.0, max(score) + (count(*) - 1) * 0.05)")


@query("""SELECT id AS thread_id, other_id, score, place FROM (SELECT bw.*, row_number() OVER (PARTITION BY bw.id ORDER BY score DESC, other_id) AS place FROM bw JOIN opn a ON a.id = bw.id JOIN opn b ON b.id = bw.other_id) WHERE place <= 8""")
def stored_neighbors(spark, root):
    """Up to 8 open neighbours of every open thread from the stored edges."""
    open_ = model.threads(spark, root).where(model.is_open()).select("id")
    rows = edges.both_ways(model.stored_edges(spark, root)).join(open_, "id", "left_semi").join(open_.withColumnRenamed("id", "other_id"), "other_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "other_id")).cast("long")
    return rows.withColumn("place", place).where("place <= 8").select(F.col("id").alias("thread_id"), "other_id", "score", "place")


@query("SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM vec")
def vector_normalize(spark, root):
    """Length of every active vector, and its first coordinate at length 1."""
    return model.vectors(spark, root).select("id", F.round(norm(F.col("vec")), 6).alias("norm"), F.round(unit(F.col("vec"))[0], 6).alias("first"))


@query("SELECT coalesce(model, '?') AS model, coalesce(basis, '?') AS basis, count(*) AS n_rows, count(DISTINCT thread_id) AS n_threads, count(*) FILTER (WHERE ltrim(vector_json) LIKE '[%') AS n_inline FROM thread_vectors GROUP BY 1, 2")
def vector_counts(spark, root):
    """Stored vectors by model and basis, and how many are inline JSON arrays."""
    rows = table(spark, root, "thread_vectors")
    keys = [F.coalesce(c, F.lit("?")).alias(c) for c in ("model", "basis")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct("thread_id").alias("n_threads"), F.count_if(F.ltrim("vector_json").startswith("[")).alias("n_inline"))


@query("SELECT opn.repo_id AS repo_id, count(DISTINCT svec.id) AS n_threads, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM opn JOIN svec USING (id) GROUP BY 1")
def clusterable_meta(spark, root):
    """Open threads with a source vector, and the kinds of sources, by repository."""
    rows = model.source_vectors(spark, root).select("source", "id").join(model.threads(spark, root).where(model.is_open()).select("id", "repo_id"), "id")
    return rows.groupBy("repo_id").agg(F.countDistinct("id").alias("n_threads"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("""SELECT th.id AS thread_id, number, kind, coalesce(d.n_comments, 0) AS n_comments, n.other_id AS best_neighbor, n.score AS best_score, doc.doc_id AS doc_id FROM th LEFT JOIN (SELECT thread_id, count(*) AS n_comments FROM cm GROUP BY 1) d ON d.thread_id = th.id
    LEFT JOIN (SELECT id, other_id, score FROM bw QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) = 1) n ON n.id = th.id LEFT JOIN documents doc ON doc.thread_id = th.id""")
def thread_detail(spark, root):
    """Every thread with its comments, document and best stored neighbour."""
    ts = model.threads(spark, root).select(F.col("id").alias("thread_id"), "number", "kind")
    talk = model.comments(spark, root).groupBy("thread_id").agg(F.count("*").alias("n_comments"))
    best = edges.both_ways(model.stored_edges(spark, root)).groupBy(F.col("id").alias("thread_id")).agg(F.max_by("other_id", F.struct("score", -F.col("other_id"))).alias("best_neighbor"), F.max("score").alias("best_score"))
    docs = table(spark, root, "documents").select("thread_id", "doc_id")
    rows = ts.join(talk, "thread_id", "left").join(best, "thread_id", "left").join(docs, "thread_id", "left")
    return rows.select("thread_id", "number", "kind", F.coalesce("n_comments", F.lit(0)).alias("n_comments"), "best_neighbor", "best_score", "doc_id")


# clusters


@query("""SELECT c.id AS cluster_id, c.repo_id, c.member_count, t.number AS representative_number, t.title AS display_title, (c.close_reason_local IS NOT NULL OR coalesce(t.state <> 'open' OR t.closed_at_local IS NOT NULL, false)) AS is_closed
    FROM (SELECT * FROM clusters WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, member_count DESC NULLS LAST) = 1) c LEFT JOIN th t ON t.id = c.representative_thread_id""")
def list_clusters(spark, root):
    """Stored clusters with their representative, largest first."""
    from threadloom.operators.latest import latest

    stored = latest(table(spark, root, "clusters"), ["id"], "created_at", "member_count").select(F.col("id").alias("cluster_id"), "repo_id", "member_count", F.col("representative_thread_id").alias("rep"), "close_reason_local")
    ts = model.threads(spark, root).select(F.col("id").alias("rep"), F.col("number").alias("representative_number"), F.col("title").alias("display_title"), model.is_closed().alias("gone"))
    closed = F.col("close_reason_local").isNotNull() | F.coalesce("gone", F.lit(False))
    return stored.join(ts, "rep", "left").select("cluster_id", "repo_id", "member_count", "representative_number", "display_title", closed.alias("is_closed")).orderBy(F.col("member_count").desc_nulls_last(), "cluster_id")


def clustered(spark, root, latest_only: bool = True):
    ts = model.threads(spark, root)
    scratch = Scratch(spark)
    eg = scratch.save(model.stored_edges(spark, root, latest_only), "edges")
    return ts, eg, scratch.save(clustering.connected_components(ts, eg, scratch), "components")


@query("SELECT id, component FROM comp", reach=True)
def connected_components(spark, root):
    return clustered(spark, root)[2]


@query("SELECT * FROM rep", reach=True)
def cluster_representative(spark, root):
    ts, eg, comp = clustered(spark, root)
    return clustering.representatives(comp, eg, ts.select("id", "number"))


@query("SELECT component, comp.id AS id, eg.score AS score_to_representative FROM comp JOIN rep USING (component) LEFT JOIN eg ON eg.left_id = least(comp.id, representative_id) AND eg.right_id = greatest(comp.id, representative_id)", reach=True)
def cluster_members_score(spark, root):
    ts, eg, comp = clustered(spark, root)
    return clustering.member_scores(comp, clustering.representatives(comp, eg, ts.select("id", "number")), eg)


_SUMMARY = """SELECT r.component, r.representative_id, t.title AS display_title, s.total, s.issues, s.pull_requests, s.latest, s.is_closed FROM rep r JOIN th t ON t.id = r.representative_id JOIN
    (SELECT component, count(*) AS total, count(*) FILTER (WHERE kind = 'issue') AS issues, count(*) FILTER (WHERE kind = 'pull_request') AS pull_requests, max(coalesce(updated_at_gh, updated_at)) AS latest, bool_and(state <> 'open' OR closed_at_local IS NOT NULL) AS is_closed, string_agg(lower(title), ' ') AS words FROM comp JOIN th USING (id) GROUP BY 1) s USING (component)"""


def summaries(spark, root, text: str = "cache", repo_id: int | None = None):
    """Each cluster's representative, counts, time and close state; ``found`` says that a member's title has the text."""
    ts, eg, comp = clustered(spark, root)
    if repo_id is not None:
        ts = ts.where(F.col("repo_id") == repo_id)
        comp = comp.join(ts.select("id"), "id", "left_semi")
    reps = clustering.representatives(comp, eg, ts.select("id", "number"))
    kind = lambda k: F.count_if(F.col("kind") == k)
    stats = comp.join(ts, "id").groupBy("component").agg(
        F.count("*").alias("total"), kind("issue").alias("issues"), kind("pull_request").alias("pull_requests"), F.max(F.coalesce("updated_at_gh", "updated_at")).alias("latest"),
        F.bool_and(model.is_closed()).alias("is_closed"), F.bool_or(F.lower("title").contains(text)).alias("found"),
    )
    titled = reps.join(ts.select(F.col("id").alias("representative_id"), F.col("title").alias("display_title")), "representative_id")
    return titled.join(stats, "component").select("component", "representative_id", "display_title", "total", "issues", "pull_requests", "latest", "is_closed", "found")


@query(_SUMMARY, reach=True)
def clustersummaries(spark, root):
    return summaries(spark, root).drop("found").orderBy(F.col("total").desc(), "component")


@query(_SUMMARY + " WHERE contains(words, 'cache')", reach=True)
def cluster_summaries_search(spark, root):
    """Clusters with a member whose title has the text."""
    return summaries(spark, root).where("found").drop("found")


@query("""SELECT component, id, number, kind, place, nullif(CASE WHEN length(b) <= 280 THEN b ELSE regexp_replace(substr(b, 1, 279), '[ ]+$', '') || chr(8230) END, '') AS body_snippet FROM
    (SELECT component, id, number, kind, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN kind = 'issue' THEN 0 ELSE 1 END, coalesce(updated_at_gh, updated_at) DESC NULLS LAST, number DESC, id) AS place FROM comp JOIN rep USING (component) JOIN th USING (id) WHERE size > 1) JOIN sq USING (id)""", reach=True)
def cluster_detail(spark, root):
    """Members of the shared clusters: issues first, then the most recent."""
    ts, _, comp = clustered(spark, root)
    shared = clustering.sizes(comp).where("size > 1").select("component")
    order = Window.partitionBy("component").orderBy(F.when(F.col("kind") == "issue", 0).otherwise(1), F.coalesce("updated_at_gh", "updated_at").desc_nulls_last(), F.col("number").desc(), "id")
    rows = comp.join(shared, "component", "left_semi").join(ts, "id")
    return rows.select("component", "id", "number", "kind", F.row_number().over(order).cast("long").alias("place"), snippet(F.col("body")).alias("body_snippet"))


@query("""SELECT c.id AS cluster_id, c.close_reason_local AS before, CASE WHEN c.close_reason_local = 'manual' THEN 'manual' WHEN bool_and(t.state <> 'open' OR t.closed_at_local IS NOT NULL) THEN 'all_members_closed' WHEN c.close_reason_local = 'all_members_closed' THEN NULL ELSE c.close_reason_local END AS after
    FROM (SELECT * FROM clusters WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, member_count DESC NULLS LAST) = 1) c JOIN comp r ON r.id = c.representative_thread_id JOIN comp m ON m.component = r.component JOIN th t ON t.id = m.id GROUP BY c.id, c.close_reason_local""", reach=True)
def cluster_close_state(spark, root):
    """Close reason of every stored cluster after a look at the members of its representative's component."""
    from threadloom.operators.latest import latest

    ts, _, comp = clustered(spark, root)
    closed = comp.join(ts, "id").groupBy("component").agg(F.bool_and(model.is_closed()).alias("all_closed"))
    stored = latest(table(spark, root, "clusters"), ["id"], "created_at", "member_count")
    rows = stored.select(F.col("id").alias("cluster_id"), F.col("representative_thread_id").alias("id"), F.col("close_reason_local").alias("before")).join(comp, "id").join(closed, "component")
    after = F.when(F.col("before") == "manual", "manual").when(F.col("all_closed"), "all_members_closed").when(F.col("before") == "all_members_closed", F.lit(None)).otherwise(F.col("before"))
    return rows.select("cluster_id", "before", after.alias("after"))


@query("SELECT size, count(*) AS n_clusters FROM rep GROUP BY 1", reach=True)
def cluster_size_histogram(spark, root):
    return clustering.sizes(clustered(spark, root)[2]).groupBy("size").agg(F.count("*").alias("n_clusters"))


@query("""SELECT CAST(sum(size) AS BIGINT) AS threads, count(*) AS clusters, count(*) FILTER (WHERE size = 1) AS solo, count(*) FILTER (WHERE size > 1) AS multi, max(size) AS max_size, round((sum(size) - count(*) FILTER (WHERE size = 1)) * 100 / sum(size), 2) AS multi_member_pct,
    round(count(*) FILTER (WHERE size = 1) * 100 / count(*), 2) AS solo_pct, round(avg(size) FILTER (WHERE size > 1), 2) AS avg_multi_size, (count(*) FILTER (WHERE size = 1) * 100 / count(*) >= 95 OR max(size) > 500 OR count(*) FILTER (WHERE size > 1) < 5) AS degenerate FROM rep""", reach=True)
def cluster_quality_metrics(spark, root):
    return clustering.quality(clustered(spark, root)[2])


_ALL = """
abw AS (SELECT left_id AS id, right_id AS other_id FROM allg UNION ALL SELECT right_id, left_id FROM allg),
areach(id, r) AS (SELECT id, id FROM th UNION SELECT abw.other_id, areach.r FROM areach JOIN abw ON abw.id = areach.id),
acomp AS (SELECT th.id, min(r) AS component FROM th JOIN areach USING (id) GROUP BY 1),
"""


@query("""SELECT a, a_size, b, shared, b_size FROM (SELECT x.component AS a, y.component AS b, count(*) AS shared, s.n AS a_size, t.n AS b_size FROM comp x JOIN acomp y USING (id) JOIN (SELECT component, count(*) AS n FROM comp GROUP BY 1) s ON s.component = x.component JOIN (SELECT component, count(*) AS n FROM acomp GROUP BY 1) t ON t.component = y.component GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b_size DESC, b) = 1""", reach=True, also=_ALL)
def clustering_overlap(spark, root):
    """Clusters of the latest runs against those of all runs together."""
    now = clustered(spark, root)[2]
    return clustering.overlap(now, clustered(spark, root, False)[2])


@query()
def bounded_clusters(spark, root):
    """Clusters of at most 5 members, strongest edges first."""
    ts, eg, comp = clustered(spark, root, False)
    return clustering.resize(comp, eg, "bounded", 5, 0.02)


@query()
def refined_clusters(spark, root):
    """Clusters above 5 members taken apart at rising thresholds."""
    ts, eg, comp = clustered(spark, root, False)
    return clustering.resize(comp, eg, "refined", 5, 0.02)


@query("""SELECT 'large' AS stratum, component, size FROM (SELECT component, size FROM rep ORDER BY size DESC, component LIMIT 5) UNION ALL SELECT stratum, component, size FROM
    (SELECT component, size, CASE WHEN size <= 3 THEN 'small' WHEN above / greatest(1, total - 1) BETWEEN 0.3 AND 0.7 THEN 'middle' END AS stratum FROM (SELECT component, size, rank() OVER (ORDER BY size DESC) - 1 AS above, count(*) OVER () AS total FROM rep) WHERE component NOT IN (SELECT component FROM rep ORDER BY size DESC, component LIMIT 5))
    WHERE stratum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || component), component) <= 5""", reach=True)
def stratified_sample(spark, root):
    return clustering.stratified(clustering.sizes(clustered(spark, root)[2]), 5, 42)


@query("""SELECT coalesce(a.size, b.size) AS size, coalesce(a.n, 0) AS left_clusters, coalesce(b.n, 0) AS right_clusters, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT size, count(*) AS n FROM rep GROUP BY 1) a
    FULL JOIN (SELECT least(member_count, 1000000) AS size, count(*) AS n FROM (SELECT * FROM clusters WHERE id IS NOT NULL AND member_count IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, member_count DESC NULLS LAST) = 1) GROUP BY 1) b ON a.size = b.size""", reach=True)
def cluster_population_compare(spark, root):
    """Cluster sizes as computed against those that the stored clusters claim."""
    from threadloom.operators.latest import latest

    stored = latest(table(spark, root, "clusters"), ["id"], "created_at", "member_count").where("member_count is not null").select(F.col("id").alias("component"), F.col("member_count").cast("long").alias("size"))
    return evaluate.compare_sizes(clustering.sizes(clustered(spark, root)[2]), stored)


def _synthetic(spark, n: int, members: int):
    scratch = Scratch(spark)
    made = evaluate.synthetic_vectors(spark, n, members)
    near = edges.nearest_neighbors(made.select(F.col("source").alias("scope"), "id", "vec"), 7, 0.82).where("left_id < right_id")
    fused = edges.fuse(near.select("left_id", "right_id", F.col("scope").alias("source"), "score"), 0.82)
    comp = clustering.connected_components(made.select("id").distinct(), fused, scratch)
    return clustering.sizes(comp).groupBy("size").agg(F.count("*").alias("n_clusters"))


@query("SELECT CAST(8 AS BIGINT) AS size, CAST(64 AS BIGINT) AS n_clusters")
def synthetic_rebuild(spark, root):
    """Clusters of the synthetic fixture of 512 threads and three sources: how many of each size are found."""
    return _synthetic(spark, 64, 8)


@query()
def synthetic_rebuild_large(spark, root):
    """The same for 1,536 threads; with 7 neighbours of 15 alike, clusters may fall apart."""
    return _synthetic(spark, 96, 16)


# search

_TEXTS = ["title", "body", "raw_text", "dedupe_text"]
_TERMS = ["cache", "log"]
_TOK = "list_filter(regexp_split_to_array(lower(concat_ws(' ', title, body, raw_text, dedupe_text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_BM = f"""(SELECT thread_id, sum_ AS bm25 FROM (SELECT thread_id, {' + '.join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(2))} AS sum_
    FROM (SELECT thread_id, len(w) AS dl, len(list_filter(w, lambda t: t = 'cache')) AS f0, len(list_filter(w, lambda t: t = 'log')) AS f1, count(*) OVER () AS n, avg(len(w)) OVER () AS avgdl, count(*) FILTER (WHERE list_contains(w, 'cache')) OVER () AS d0, count(*) FILTER (WHERE list_contains(w, 'log')) OVER () AS d1 FROM (SELECT thread_id, {_TOK} AS w FROM documents)) WHERE f0 > 0 AND f1 > 0))"""
_KW = f"(SELECT thread_id, bm25, 1 / (1 + abs(bm25)) AS keyword_score FROM {_BM} WHERE thread_id IN (SELECT id FROM opn) ORDER BY round(bm25, 9) DESC, thread_id LIMIT 40)"
_SEM = "(SELECT vec.id AS thread_id, list_cosine_similarity(v, q) AS semantic_score FROM vec, (SELECT v AS q, id AS qid FROM vec ORDER BY id LIMIT 1) WHERE vec.id IN (SELECT id FROM opn) AND vec.id <> qid AND len(v) = len(q) AND list_cosine_similarity(v, q) >= 0.2 ORDER BY round(list_cosine_similarity(v, q), 9) DESC, vec.id LIMIT 40)"


@query(f"SELECT thread_id, round(bm25, 6) AS bm25 FROM {_BM}")
def bm25_topk(spark, root):
    """BM25 of every document that has all terms, in one pass over the texts."""
    return search.bm25(table(spark, root, "documents"), "thread_id", _TEXTS, _TERMS).select("thread_id", F.round("bm25", 6).alias("bm25"))


@query(f"SELECT thread_id, round(bm25, 6) AS bm25, round(keyword_score, 6) AS keyword_score FROM {_KW}")
def search_keyword(spark, root):
    from threadloom.plans.serving import text_index

    found = search.keyword(text_index(spark, root), model.threads(spark, root).where(model.is_open()), " ".join(_TERMS))
    return found.select("thread_id", F.round("bm25", 6).alias("bm25"), F.round("keyword_score", 6).alias("keyword_score"))


@query(f"SELECT thread_id, round(coalesce(keyword_score, 0), 6) AS keyword_score, round(coalesce(semantic_score, 0), 6) AS semantic_score, round(coalesce(keyword_score, 0) + coalesce(semantic_score, 0), 6) AS hybrid_score FROM {_KW} k FULL JOIN {_SEM} s USING (thread_id) JOIN opn ON opn.id = thread_id ORDER BY round(coalesce(keyword_score, 0) + coalesce(semantic_score, 0), 9) DESC, updated_at_gh DESC NULLS LAST, number DESC LIMIT 20")
def search_hybrid(spark, root):
    """Keyword and semantic legs together; the query vector is that of the first thread, read as one row."""
    from threadloom.plans.serving import text_index

    open_ = model.threads(spark, root).where(model.is_open())
    vecs = Scratch(spark).save(model.vectors(spark, root), "vectors")
    first = vecs.orderBy("id").limit(1).collect()
    key = search.keyword(text_index(spark, root), open_, " ".join(_TERMS))
    found = vecs.join(open_.select("id"), "id", "left_semi")
    sem = search.semantic(found, list(first[0]["vec"]) if first else [], skip=first[0]["id"] if first else None)
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return search.hybrid(key, sem, open_).select("thread_id", score("keyword_score"), score("semantic_score"), score("hybrid_score"))


@query(f"SELECT term, count(*) AS n_documents, CAST(sum(tf) AS BIGINT) AS n_occurrences FROM (SELECT thread_id, term, count(*) AS tf FROM (SELECT thread_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def postings_df(spark, root):
    return search.postings(table(spark, root, "documents"), "thread_id", _TEXTS)
