"""Queries of synchronisation, pipeline state and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import clustering, edges, merge, sync
from threadloom.operators.documents import source_tasks, summary_sources
from threadloom.operators.latest import latest
from threadloom.operators.vectors import usable_rows
from threadloom.operators.state import currency, desired_stamps, pending_summaries, workset
from threadloom.plans import experiments, model
from threadloom.plans.catalogue import _ALL, _CUT, _WS, query
from threadloom.session import Scratch
from threadloom.sources.tables import table

NOW, CRAWL = "2026-11-01T00:00:00.000Z", "2027-01-01T00:00:00.000Z"
_KEY = ["repo_id", "kind", "number"]
_FIRST = "fs AS (SELECT * FROM threads WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, kind, number ORDER BY updated_at ASC NULLS LAST, content_hash ASC NULLS LAST) = 1),"
_STALE = "(SELECT * FROM fs WHERE state = 'open' AND closed_at_local IS NULL AND (last_pulled_at IS NULL OR last_pulled_at < '2027-01-01T00:00:00.000Z'))"


def _older(spark, root):
    """The threads as they were first stored."""
    return merge.first_snapshot(table(spark, root, "threads").where("id is not null").drop("raw_json", "body"), _KEY, "updated_at")


@query(f"""SELECT fs.id, fs.number, coalesce(u.state, fs.state) AS state, CASE WHEN u.id IS NOT NULL THEN u.closed ELSE fs.closed_at_gh END AS closed_at_gh, CASE WHEN u.id IS NOT NULL THEN '2026-11-01T00:00:00.000Z' ELSE fs.last_pulled_at END AS last_pulled_at FROM fs LEFT JOIN
    (SELECT s.id, p.state, p.closed FROM {_STALE} s JOIN (SELECT repo_id, number, 'closed' AS state, max(coalesce(closed_at_gh, '')) AS m, nullif(max(coalesce(closed_at_gh, '')), '') AS closed FROM th WHERE state = 'closed' GROUP BY repo_id, number) p USING (repo_id, number)) u ON u.id = fs.id""", also=_FIRST)
def closed_sweep_merge(spark, root):
    """The first snapshots, with the stale open ones updated that a later listing has as closed under the same number."""
    old = _older(spark, root)
    listing = model.threads(spark, root).where("state = 'closed'").select("repo_id", "number", "state", "closed_at_gh", "updated_at_gh")
    return sync.apply_updates(old, sync.closed_updates(old, listing, CRAWL, NOW)).select("id", "number", "state", "closed_at_gh", "last_pulled_at")


@query(f"""SELECT fs.id, CASE WHEN s.id IS NULL THEN fs.state WHEN a.number IS NULL THEN 'closed' ELSE a.state END AS state, CASE WHEN s.id IS NULL THEN fs.closed_at_gh WHEN a.number IS NULL THEN coalesce(fs.closed_at_gh, '2026-11-01T00:00:00.000Z') ELSE a.closed_at_gh END AS closed_at_gh FROM fs LEFT JOIN {_STALE} s ON s.id = fs.id
    LEFT JOIN (SELECT repo_id, number, arg_max(state, {{'u': coalesce(updated_at, ''), 'i': id}}) AS state, arg_max({{'c': closed_at_gh}}, {{'u': coalesce(updated_at, ''), 'i': id}}).c AS closed_at_gh FROM th WHERE last_pulled_at >= '2024-01-01T00:00:00.000Z' GROUP BY 1, 2) a ON a.repo_id = fs.repo_id AND a.number = fs.number""", also=_FIRST)
def full_reconciliation(spark, root):
    """The first snapshots after a look at each stale open one: what was not pulled since 2024 has no answer and is closed."""
    old = _older(spark, root)
    found = model.threads(spark, root).where("last_pulled_at >= '2024-01-01T00:00:00.000Z'")
    newest = F.max_by(F.struct("state", "closed_at_gh", "updated_at_gh"), F.struct(F.coalesce("updated_at", F.lit("")), "id"))
    answers = found.groupBy("repo_id", "number").agg(newest.alias("s")).select("repo_id", "number", "s.*", F.lit(None).cast("string").alias("error"))
    return sync.apply_updates(old, sync.reconciled_updates(old, answers, CRAWL, NOW)).select("id", "state", "closed_at_gh")


@query("""SELECT id, CASE WHEN is_draft IS NULL AND closed_at_gh IS NULL AND first_pulled_at IS NULL THEN 'full' WHEN is_draft IS NULL AND first_pulled_at IS NOT NULL AND last_pulled_at <= first_pulled_at THEN 'overlapping' ELSE 'non-overlapping' END AS kind FROM (SELECT id, nullif(is_draft, 0) AS is_draft, closed_at_gh, first_pulled_at, last_pulled_at FROM th)""")
def scan_kinds(spark, root):
    """The kind of a scan by its limit (the draft mark), start (time closed), reference (first pull) and effective start (last pull)."""
    limit = F.nullif(F.col("is_draft"), F.lit(0))
    return model.threads(spark, root).select("id", sync.scan_kind(limit, F.col("closed_at_gh"), F.col("first_pulled_at"), F.col("last_pulled_at")).alias("kind"))


@query("SELECT thread_id, count(*) AS n, count(*) FILTER (WHERE coalesce(updated_at_gh, '') >= '2024') AS late FROM cm WHERE thread_id NOT IN (SELECT id FROM th WHERE state = 'closed') OR coalesce(updated_at_gh, '') < '2024' GROUP BY 1")
def comments_replaced(spark, root):
    """Comments by thread after those of closed threads were read again, and only what is older than 2024 was still there."""
    rows = model.comments(spark, root)
    read = model.threads(spark, root).where("state = 'closed'").select("id")
    incoming = rows.join(read.select(F.col("id").alias("thread_id")), "thread_id", "left_semi").where(F.coalesce("updated_at_gh", F.lit("")) < "2024")
    left = sync.hydrate(rows, incoming, read)
    return left.groupBy("thread_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("updated_at_gh", F.lit("")) >= "2024").alias("late"))


@query("SELECT id AS thread_id, coalesce(n, 0) AS purged FROM th LEFT JOIN (SELECT thread_id AS id, count(*) AS n FROM cm GROUP BY 1) USING (id) WHERE repo_id = 1")
def comments_purged(spark, root):
    """Comments that go with a purge of repository 1, thread by thread."""
    return sync.purge_comments(model.comments(spark, root), model.threads(spark, root).where("repo_id = 1"))[1]


@query("""SELECT repo_id, arg_max(crawl, id) FILTER (WHERE f AND crawl IS NOT NULL) AS last_full_open_scan_started_at, arg_max(fin, id) FILTER (WHERE o AND fin IS NOT NULL) AS last_overlapping_open_scan_completed_at, arg_max(fin, id) FILTER (WHERE NOT f AND NOT o AND fin IS NOT NULL) AS last_non_overlapping_scan_completed_at, arg_max(rec, id) FILTER (WHERE rec IS NOT NULL) AS last_open_close_reconciled_at
    FROM (SELECT id, repo_id, last_pulled_at AS fin, first_pulled_at AS crawl, kind = 'issue' AS f, state = 'closed' AS o, closed_at_gh AS rec FROM th WHERE closed_at_local IS NULL) GROUP BY 1""")
def cursors_from_runs(spark, root):
    """The four cursors of every repository from a log of runs; each thread stands for a run, those closed here for failed ones."""
    stats = F.to_json(F.struct(F.col("first_pulled_at").alias("crawl_started_at"), (F.col("kind") == "issue").alias("is_full_open_scan"), (F.col("state") == "closed").alias("is_overlapping_open_scan"), F.col("closed_at_gh").alias("reconciled_open_close_at")))
    runs = model.threads(spark, root).select("id", "repo_id", F.when(F.col("closed_at_local").isNull(), "completed").otherwise("failed").alias("status"), F.col("last_pulled_at").alias("finished_at"), stats.alias("stats"))
    return sync.derived_cursors(runs)


_SUM = "(SELECT sq.id AS thread_id, sha256('summary:v1:metadata-only' || chr(10) || concat_ws(chr(10) || chr(10), 'title: ' || t, 'body: ' || nullif(b, ''), 'labels: ' || nullif(l, ''))) AS h FROM sq JOIN opn USING (id))"


@query(f"SELECT s.thread_id FROM {_SUM} s LEFT JOIN (SELECT thread_id, count(*) AS n, any_value(basis) AS b FROM thread_vectors WHERE basis IS NOT NULL GROUP BY 1 HAVING count(DISTINCT basis) = 1) v USING (thread_id) WHERE NOT coalesce(v.b = 'title_original', false)")
def stale_summaries(spark, root):
    """Open threads whose summary is missing or was made by another prompt; a stored vector of one basis stands for a summary of the same
    content, and its basis for the prompt."""
    ts = model.threads(spark, root).where(model.is_open())
    sources = summary_sources(ts, model.comments(spark, root), False)
    one = table(spark, root, "thread_vectors").where("basis is not null").groupBy("thread_id").agg(F.countDistinct("basis").alias("n"), F.min("basis").alias("prompt_version")).where("n = 1")
    stored = sources.select("thread_id", "content_hash").join(one, "thread_id").select("thread_id", "content_hash", "prompt_version")
    return pending_summaries(sources, stored, "title_original").select("thread_id")


_SUMMARY = "(SELECT thread_id AS id, squashed AS s FROM (SELECT thread_id, trim(regexp_replace(coalesce(title, ''), '" + _WS + "', ' ', 'g')) AS squashed FROM documents WHERE lang = 'en' AND thread_id IS NOT NULL) WHERE squashed <> '')"
_WORK = f"(SELECT id, number, {_CUT} AS x, s FROM (SELECT opn.id, number, s, concat_ws(chr(10) || chr(10), 'title: ' || t, 'summary: ' || s) AS w FROM opn JOIN sq USING (id) LEFT JOIN {_SUMMARY} USING (id)))"


@query(f"SELECT id AS thread_id, CASE WHEN s IS NULL THEN NULL ELSE sha256('embedding:vectorlite-1024-v1:title_summary:text-embedding-3-large:1024' || chr(10) || x) END AS content_hash FROM {_WORK}")
def summary_workset(spark, root):
    """Open threads by the basis of title and summary: the hash of what is to be embedded, null without a summary. Titles of English
    documents stand for summaries."""
    ts = model.threads(spark, root).where(model.is_open())
    made = table(spark, root, "documents").where("lang = 'en' and thread_id is not null").select("thread_id", F.col("title").alias("summary_text"))
    tasks, missing = workset(ts, made, ts.select(F.col("id").alias("thread_id"), F.lit("").alias("content_hash")), "title_summary")
    return tasks.select("thread_id", "content_hash").unionByName(missing.select("thread_id", F.lit(None).cast("string").alias("content_hash")))


@query(f"""SELECT id AS thread_id, k AS source_kind, sha256('embedding:' || k || chr(10) || x) AS content_hash FROM (SELECT id, k, {_CUT} AS x FROM (SELECT sq.id, u.k, CASE u.k WHEN 'title' THEN t WHEN 'body' THEN b ELSE d END AS w FROM sq LEFT JOIN (SELECT thread_id AS id, trim(regexp_replace(coalesce(dedupe_text, ''), '{_WS}', ' ', 'g')) AS d FROM documents WHERE thread_id IS NOT NULL) USING (id), (SELECT unnest(['title', 'body', 'dedupe_summary']) AS k) u) WHERE w <> '')""")
def three_source_tasks(spark, root):
    """Title, body and a summary of every thread as texts to embed on their own; the text for comparison stands for the summary."""
    made = table(spark, root, "documents").where("thread_id is not null").select("thread_id", F.col("dedupe_text").alias("summary_text"))
    return source_tasks(model.threads(spark, root), made).select("thread_id", "source_kind", "content_hash")


@query("""SELECT repo_id, (coalesce(model = 'trellis-embed-l', false) AND made IS NOT NULL) AS vectors_current, (coalesce(model = 'trellis-embed-l', false) AND made IS NOT NULL AND cl IS NOT NULL) AS clusters_current FROM
    (SELECT repo_id, max(model) AS model, max(v.updated_at) AS made FROM th JOIN thread_vectors v ON v.thread_id = th.id GROUP BY 1) LEFT JOIN (SELECT repo_id, max(created_at) AS cl FROM clusters WHERE repo_id IS NOT NULL GROUP BY 1) USING (repo_id)""")
def pipeline_currency(spark, root):
    """Whether the vectors and clusters of every repository are as they would be made now; the stamps come from the stored vectors."""
    per = table(spark, root, "thread_vectors").join(model.threads(spark, root).select(F.col("id").alias("thread_id"), "repo_id"), "thread_id").groupBy("repo_id").agg(F.max("model").alias("embed_model"), F.max("updated_at").alias("vectors_current_at"))
    made = table(spark, root, "clusters").where("repo_id is not null").groupBy("repo_id").agg(F.max("created_at").alias("clusters_current_at"))
    want = desired_stamps(model=model.MODEL)
    state = per.join(made, "repo_id", "left").select("*", *(F.lit(v).alias(k) for k, v in want.items() if k != "embed_model"))
    return currency(state, want)


@query("SELECT component, size, row_number() OVER (ORDER BY size DESC, first, component) AS place FROM (SELECT component, count(*) AS size, min(number) AS first FROM comp JOIN th USING (id) GROUP BY 1)", reach=True)
def cluster_order(spark, root):
    """Clusters in the order in which they get their ids: by size, ties to the smallest number."""
    from threadloom.plans.catalogue import clustered

    ts, _, comp = clustered(spark, root)
    return clustering.ordered(comp, ts)


@query("SELECT id, min(r) AS component FROM rr GROUP BY 1", also=_ALL + """
pick AS (SELECT component FROM (SELECT component, count(*) AS size, min(number) AS first FROM acomp JOIN th USING (id) GROUP BY 1) ORDER BY size DESC, first, component LIMIT 1),
pv AS (SELECT acomp.id, v FROM acomp JOIN pick USING (component) LEFT JOIN vec ON vec.id = acomp.id),
pe AS (SELECT a.id AS x, b.id AS y FROM pv a JOIN pv b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.5 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) <= 6),
pb AS (SELECT x, y FROM pe UNION SELECT y, x FROM pe),
rr(id, r) AS (SELECT id, id FROM pv UNION SELECT pb.y, rr.r FROM rr JOIN pb ON pb.x = rr.id),
""")
def refined_largest(spark, root):
    """The largest cluster of all runs, clustered again by its members' own neighbours."""
    from threadloom.plans.catalogue import clustered

    ts, _, comp = clustered(spark, root, False)
    return clustering.refine_one(comp, model.vectors(spark, root), ts, 1, 6, 0.5, Scratch(spark))


@query("SELECT u.mode AS mode, (SELECT count(*) FROM th) AS n_members, 0 AS too_large, 0 AS across FROM (SELECT unnest(['bounded', 'refined']) AS mode) u")
def resized_clusters(spark, root):
    """Of the bounded and the refined clusters: members, clusters above 5 members, and clusters of several components; the last two must be 0."""
    from threadloom.plans.catalogue import clustered

    _, eg, comp = clustered(spark, root, False)
    out = None
    for mode in ("bounded", "refined"):
        parts = clustering.resize(comp, eg, mode, 5, 0.02).withColumnRenamed("component", "part").join(comp, "id")
        per = parts.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("component").alias("of"))
        row = per.agg(F.sum("n").alias("n_members"), F.count_if(F.col("n") > 5).cast("int").alias("too_large"), F.count_if(F.col("of") > 1).cast("int").alias("across")).select(F.lit(mode).alias("mode"), "*")
        out = row if out is None else out.unionAll(row)
    return out


@query()
def experiment_matrix(spark, root):
    """Clusterings of the source vectors by several sources and fusions: edges, clusters, sizes."""
    rows = model.source_vectors(spark, root).withColumnRenamed("id", "thread_id")
    return experiments.matrix(rows, Scratch(spark), experiments.CONFIGS, 25, 0.0)


@query("SELECT opn.id AS id, opn.repo_id AS repo_id, opn.number AS number, len(v) AS dimensions FROM opn JOIN (SELECT thread_id AS id, TRY_CAST(TRY_CAST(vector_json AS JSON) AS DOUBLE[]) AS v FROM thread_vectors WHERE model = 'trellis-embed-l' AND basis = 'title_original' AND dimensions = 96 AND thread_id IS NOT NULL AND len(TRY_CAST(TRY_CAST(vector_json AS JSON) AS DOUBLE[])) = 96 AND len(list_filter(TRY_CAST(TRY_CAST(vector_json AS JSON) AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(TRY_CAST(TRY_CAST(vector_json AS JSON) AS DOUBLE[]), lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY updated_at DESC NULLS LAST, vector_json DESC) = 1) USING (id)")
def clusterable_vectors(spark, root):
    """Open threads with a usable vector of the wanted model, basis and length, in order of number."""
    stored = table(spark, root, "thread_vectors").where((F.col("model") == model.MODEL) & (F.col("basis") == "title_original") & (F.col("dimensions") == 96))
    rows = latest(usable_rows(stored, ["thread_id", "updated_at"], "vector_json", "dimensions"), ["thread_id"], "updated_at", "vec")
    ts = model.threads(spark, root).where(model.is_open()).select("id", "repo_id", "number")
    return ts.join(rows.select(F.col("thread_id").alias("id"), F.size("vec").cast("long").alias("dimensions")), "id").orderBy("number", "id")


@query("SELECT id, other_id, round(score, 6) AS score FROM (SELECT q.id AS id, v.id AS other_id, list_inner_product(q.v, v.v) AS score FROM vec q JOIN vec v ON q.id <> v.id AND len(q.v) = len(v.v) WHERE q.id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other_id) <= 3")
def dot_topk(spark, root):
    """The 3 best by inner product, of all threads, for every thread whose id is divisible by 50."""
    rows = Scratch(spark).save(model.vectors(spark, root), "vectors")
    return edges.top_k(rows.where("id % 50 = 0"), rows, 3).select("id", "other_id", F.round("score", 6).alias("score"))
