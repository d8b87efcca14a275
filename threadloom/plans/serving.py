"""Views for clients, with their parameters: threads, clusters, snapshots, details, searches."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.config import HIT_NEIGHBORS, NEIGHBOR_FLOOR, STORED_NEIGHBORS
from threadloom.functions.text import names_of, snippet
from threadloom.operators import clustering, edges, search
from threadloom.operators.latest import latest
from threadloom.plans import model
from threadloom.plans.catalogue import _TEXTS, _THREAD, query
from threadloom.session import Scratch
from threadloom.sources.tables import table

SNAPSHOT_LEAST = 10


def stored_clusters(spark: SparkSession, root: str) -> DataFrame:
    """The stored clusters of each repository's latest run, whether it is current or not."""
    rows = latest(table(spark, root, "clusters"), ["id"], "created_at", "member_count")
    newest = rows.where("repo_id is not null").groupBy("repo_id").agg(F.max("cluster_run_id").alias("cluster_run_id"))
    return rows.join(newest, ["repo_id", "cluster_run_id"], "left_semi")


def cluster_members(spark: SparkSession, root: str) -> DataFrame:
    """``(cluster_id, id)``: the members of stored clusters are those that the stored edges link with their representative."""
    ts = model.threads(spark, root)
    scratch = Scratch(spark)
    eg = scratch.save(model.stored_edges(spark, root, latest_only=False), "edges")
    comp = scratch.save(clustering.connected_components(ts, eg, scratch), "components")
    reps = stored_clusters(spark, root).select(F.col("id").alias("cluster_id"), F.col("representative_thread_id").alias("id"))
    return reps.join(comp, "id").select("cluster_id", "component").join(comp, "component").select("cluster_id", "id")


def threads_view(spark: SparkSession, root: str, repo_id: int | None = None, kind: str | None = None, numbers: list[int] | None = None, include_closed: bool = False, limit: int = 0) -> DataFrame:
    """Threads, newest first, or in the order of the ``numbers`` asked for (repeats and numbers below 1 are left out; none left, no rows);
    with the smallest of their stored clusters. ``limit`` 0 is all."""
    rows = model.threads(spark, root)
    if repo_id is not None:
        rows = rows.where(F.col("repo_id") == repo_id)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if not include_closed:
        rows = rows.where(model.is_open())
    order = [F.col("updated_at_gh").desc_nulls_last(), F.col("number").desc(), "id"]
    if numbers is not None:
        asked = list(dict.fromkeys(n for n in numbers if isinstance(n, int) and n > 0))
        places = spark.createDataFrame([(n, i) for i, n in enumerate(asked)], "number long, place int")
        rows, order = rows.join(F.broadcast(places), "number"), ["place", "repo_id", "kind", "id"]  # as many rows as were asked for
    of = cluster_members(spark, root).groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    found = rows.join(of, "id", "left").orderBy(*order)
    found = found.limit(limit) if limit else found
    return found.select(*_THREAD, F.array_join(names_of(F.col("labels_json"), "name"), "|").alias("labels"), model.is_closed().alias("is_closed"), "cluster_id")


def clusters_view(spark: SparkSession, root: str, include_closed: bool = False) -> DataFrame:
    """Stored clusters with their members in order of number, largest first; closed is one with a reason, or whose members all are."""
    ts = model.threads(spark, root).select("id", "number", "kind", "title", model.is_closed().alias("gone"))
    member = F.struct("number", "id", "kind", "title", "gone")
    lists = cluster_members(spark, root).join(ts, "id").groupBy("cluster_id").agg(F.sort_array(F.collect_list(member)).alias("members"), F.count("*").alias("n_members"), F.bool_and("gone").alias("all_gone"))
    rows = stored_clusters(spark, root).withColumnRenamed("id", "cluster_id").join(lists, "cluster_id", "left")
    closed = F.col("close_reason_local").isNotNull() | F.coalesce("all_gone", F.lit(False))
    rows = rows.withColumn("is_closed", closed)
    if not include_closed:
        rows = rows.where(~F.col("is_closed"))
    return rows.select("cluster_id", "repo_id", "member_count", "is_closed", F.coalesce("n_members", F.lit(0)).alias("n_members"), "members").orderBy(F.col("member_count").desc_nulls_last(), "cluster_id")


def snapshot(spark: SparkSession, root: str, repo_id: int | None = None, least: int = SNAPSHOT_LEAST, sort: str = "recent", text: str = "", include_closed: bool = True, limit: int = 0) -> DataFrame:
    """Summaries of the computed clusters: at least ``least`` members, a member's title that has ``text``, by time or by size."""
    from threadloom.plans.catalogue import summaries

    rows = summaries(spark, root, text.strip().lower(), repo_id).where(F.col("total") >= least)
    if text.strip():
        rows = rows.where("found")
    if not include_closed:
        rows = rows.where(~F.col("is_closed"))
    by = {"recent": [F.col("latest").desc_nulls_last(), F.col("total").desc()], "size": [F.col("total").desc(), F.col("latest").desc_nulls_last()]}[sort]
    rows = rows.drop("found").orderBy(*by, "component")
    return rows.limit(limit) if limit else rows


def detail(spark: SparkSession, root: str, component: int, most: int = 0) -> DataFrame:
    """Members of one computed cluster, issues first, then the most recent, with snippets and texts to compare; an unknown cluster raises a LookupError."""
    from threadloom.plans.catalogue import clustered

    ts, _, comp = clustered(spark, root)
    members = comp.where(F.col("component") == component)
    if members.isEmpty():
        raise LookupError(f"no cluster {component}")
    order = Window.partitionBy("component").orderBy(F.when(F.col("kind") == "issue", 0).otherwise(1), F.coalesce("updated_at_gh", "updated_at").desc_nulls_last(), F.col("number").desc(), "id")
    docs = table(spark, root, "documents").select(F.col("thread_id").alias("id"), "dedupe_text")
    rows = members.join(ts, "id").withColumn("place", F.row_number().over(order)).join(docs, "id", "left")
    rows = rows.where(F.col("place") <= most) if most else rows
    return rows.select("component", "id", "number", "kind", "place", snippet(F.col("body")).alias("body_snippet"), F.create_map(F.lit("dedupe"), F.col("dedupe_text")).alias("summaries"))


def thread_view(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """The threads of ``ids`` ``(id)`` with their smallest cluster, their texts by kind of source, and 8 stored neighbours, or else
    the 8 nearest by their vectors."""
    ts = model.threads(spark, root).join(ids, "id", "left_semi")
    of = cluster_members(spark, root).join(ids, "id", "left_semi").groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    kinds = latest(table(spark, root, "document_embeddings"), ["thread_id", "source_kind"], "updated_at", "content_hash").groupBy(F.col("thread_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("source_kind")), ",").alias("sources"))
    stored = edges.both_ways(model.stored_edges(spark, root)).join(ids, "id", "left_semi").select("id", "other_id", "score")
    bare = ids.join(stored.select("id").distinct(), "id", "left_anti")
    rows = model.scoped(model.vectors(spark, root), model.threads(spark, root))
    near = edges.neighbors_of(rows.join(bare, "id", "left_semi"), rows, STORED_NEIGHBORS, NEIGHBOR_FLOOR).select(F.col("left_id").alias("id"), F.col("right_id").alias("other_id"), "score")
    hits = search.with_neighbors(ts.select(F.col("id").alias("thread_id"), "number", "kind"), stored.unionByName(near), STORED_NEIGHBORS)
    return hits.join(of.withColumnRenamed("id", "thread_id"), "thread_id", "left").join(kinds.withColumnRenamed("id", "thread_id"), "thread_id", "left")


@lru_cache(maxsize=8)
def _index_root(app: str, root: str, shared: Scratch) -> str:
    search.build_index(table(shared.spark, root, "documents"), "thread_id", _TEXTS, f"{shared.root}/index")
    return f"{shared.root}/index"


_SHARED: dict[str, Scratch] = {}


def text_index(spark: SparkSession, root: str) -> search.TextIndex:
    """The index of the documents' texts, built once for a folder of tables in one run."""
    app = spark.sparkContext.applicationId
    shared = _SHARED.setdefault(f"{app} {root}", Scratch(spark, keep=True))
    return search.open_index(spark, _index_root(app, root, shared))


def search_view(spark: SparkSession, root: str, text: str, repo_id: int | None = None, mode: str = "keyword", limit: int = 20) -> DataFrame:
    """Open threads of a repository, or of all, that match, with their scores and 3 strongest stored neighbours. ``mode``: keyword, semantic, hybrid.

    The query vector is that of the best keyword match, as there is no provider offline; without one the semantic leg is empty.
    """
    open_ = model.threads(spark, root).where(model.is_open())
    open_ = open_ if repo_id is None else open_.where(F.col("repo_id") == repo_id)
    key = search.keyword(text_index(spark, root), open_, text, limit)
    sem = key.select("thread_id", F.lit(None).cast("double").alias("semantic_score")).limit(0)
    if mode != "keyword":
        vecs = model.vectors(spark, root).join(open_.select("id"), "id", "left_semi")
        first = key.orderBy(F.round("bm25", 9).desc(), "thread_id").join(vecs.select(F.col("id").alias("thread_id"), "vec"), "thread_id").orderBy(F.round("bm25", 9).desc(), "thread_id").limit(1).collect()
        if first:
            sem = search.semantic(vecs, list(first[0]["vec"]), limit)
    if mode == "semantic":
        key = key.limit(0)
    hits = search.hybrid(key, sem, open_, limit)
    return search.with_neighbors(hits, edges.both_ways(model.stored_edges(spark, root)), HIT_NEIGHBORS)


# queries

_RUNS = "(SELECT * FROM (SELECT * FROM clusters WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, member_count DESC NULLS LAST) = 1) WHERE (repo_id, cluster_run_id) IN (SELECT (repo_id, max(cluster_run_id)) FROM (SELECT * FROM clusters WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, member_count DESC NULLS LAST) = 1) WHERE repo_id IS NOT NULL GROUP BY repo_id))"
_REACHED = """
abw AS (SELECT left_id AS id, right_id AS other_id FROM allg UNION ALL SELECT right_id, left_id FROM allg),
areach(id, r) AS (SELECT id, id FROM th UNION SELECT abw.other_id, areach.r FROM areach JOIN abw ON abw.id = areach.id),
acomp AS (SELECT th.id, min(r) AS component FROM th JOIN areach USING (id) GROUP BY 1),
"""
_MEMBERS = f"(SELECT r.id AS cluster_id, m.id AS id FROM {_RUNS} r JOIN acomp c ON c.id = r.representative_thread_id JOIN acomp m ON m.component = c.component)"


@query(f"SELECT th.id, repo_id, number, kind, state, title, author_login, html_url, updated_at_gh, array_to_string(labels, '|') AS labels, (state <> 'open' OR closed_at_local IS NOT NULL) AS is_closed, k.cluster_id FROM th JOIN lab USING (id) LEFT JOIN (SELECT id, min(cluster_id) AS cluster_id FROM {_MEMBERS} GROUP BY 1) k ON k.id = th.id WHERE repo_id = 1 AND kind = 'issue'", also=_REACHED)
def threads_of_kind(spark, root):
    """Issues of repository 1, open or not, with their clusters."""
    return threads_view(spark, root, 1, "issue", include_closed=True)


@query(f"""SELECT r.id AS cluster_id, r.repo_id, r.member_count, (r.close_reason_local IS NOT NULL OR coalesce(m.all_gone, false)) AS is_closed, coalesce(m.n, 0) AS n_members, m.numbers FROM {_RUNS} r
    LEFT JOIN (SELECT cluster_id, count(*) AS n, bool_and(state <> 'open' OR closed_at_local IS NOT NULL) AS all_gone, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number, th.id) AS numbers FROM {_MEMBERS} x JOIN th ON th.id = x.id GROUP BY 1) m ON m.cluster_id = r.id""", also=_REACHED)
def clusters_with_members(spark, root):
    """Stored clusters of the latest runs with the numbers of their members; closed are those whose members all are."""
    rows = clusters_view(spark, root, include_closed=True)
    return rows.select("cluster_id", "repo_id", "member_count", "is_closed", "n_members", F.array_join(F.transform("members", lambda m: m["number"].cast("string")), ",").alias("numbers"))


@query("SELECT * FROM (SELECT r.component, r.size AS total, max(coalesce(t.updated_at_gh, t.updated_at)) AS latest, bool_and(t.state <> 'open' OR t.closed_at_local IS NOT NULL) AS is_closed FROM rep r JOIN comp c USING (component) JOIN th t ON t.id = c.id GROUP BY 1, 2) WHERE total >= 2 AND NOT is_closed", reach=True)
def snapshot_open(spark, root):
    """Clusters of two or more that are not closed, the most recent first."""
    return snapshot(spark, root, least=2, include_closed=False).select("component", "total", "latest", "is_closed")


@query("SELECT id AS thread_id, number, kind, cluster_id, sources, stored FROM th LEFT JOIN (SELECT id, min(cluster_id) AS cluster_id FROM " + _MEMBERS + " GROUP BY 1) k USING (id) LEFT JOIN (SELECT thread_id AS id, string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) AS sources FROM document_embeddings WHERE source_kind IS NOT NULL GROUP BY 1) d USING (id) LEFT JOIN (SELECT id, string_agg(CAST(other_id AS VARCHAR), ',' ORDER BY score DESC, other_id) AS stored FROM (SELECT * FROM bw QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) <= 8) GROUP BY 1) n USING (id) WHERE n.stored IS NOT NULL", also=_REACHED)
def thread_views(spark, root):
    """Every thread that has stored neighbours, with cluster, sources and up to 8 of them."""
    ids = edges.both_ways(model.stored_edges(spark, root)).select("id").distinct().join(model.threads(spark, root).select("id"), "id", "left_semi")
    rows = thread_view(spark, root, ids)
    return rows.select("thread_id", "number", "kind", "cluster_id", "sources", F.array_join(F.transform("neighbors", lambda n: n["thread_id"].cast("string")), ",").alias("stored"))


_IDX = "t AS (SELECT thread_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, body, raw_text, dedupe_text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),"
_NUM = "st AS (SELECT thread_id, len(w) AS dl, count(*) OVER () AS n, avg(len(w)) OVER () AS avgdl, {tf} FROM t), sd AS (SELECT *, {df} FROM st),"


def _searched(name: str, text: str, counts: list[str], where: str, scored: int) -> None:
    tf = ", ".join(f"{c} AS f{i}" for i, c in enumerate(counts))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) OVER () AS d{i}" for i in range(len(counts)))
    score = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(scored))

    def run(spark, root):
        return search.search_index(text_index(spark, root), text).select(F.col("doc").alias("thread_id"), F.round("bm25", 6).alias("bm25"))

    run.__name__, run.__doc__ = name, f"BM25 of all documents that match: {text}"
    query(f"SELECT thread_id, round({score}, 6) AS bm25 FROM sd WHERE {where}", also=_IDX + _NUM.format(tf=tf, df=df))(run)


_ONE = "len(list_filter(w, lambda x: x = '{}'))"
_TWO = "len(list_filter(range(1, len(w)), lambda i: w[i] = '{}' AND w[i + 1] = '{}'))"
_searched("search_or", "cache OR timeout", [_ONE.format("cache"), _ONE.format("timeout")], "f0 > 0 OR f1 > 0", 2)
_searched("search_not", "cache NOT log", [_ONE.format("cache"), _ONE.format("log")], "f0 > 0 AND f1 = 0", 1)
_searched("search_phrase", '"the cache"', [_TWO.format("the", "cache")], "f0 > 0", 1)
_searched("search_prefix", "time* cache", ["len(list_filter(w, lambda x: starts_with(x, 'time')))", _ONE.format("cache")], "f0 > 0 AND f1 > 0", 2)


@query("""SELECT k.thread_id, round(1 / (1 + bm25), 6) AS keyword_score, (SELECT string_agg(CAST(other_id AS VARCHAR), ',' ORDER BY score DESC, other_id) FROM (SELECT * FROM bw QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) <= 3) x WHERE x.id = k.thread_id) AS neighbors
    FROM (SELECT thread_id, greatest(1e-6, ln((n - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm25 FROM sd WHERE f0 > 0 AND thread_id IN (SELECT id FROM opn WHERE repo_id = 1) ORDER BY round(bm25, 9) DESC, thread_id LIMIT 400) k JOIN opn ON opn.id = k.thread_id ORDER BY round(1 / (1 + bm25), 9) DESC, updated_at_gh DESC NULLS LAST, number DESC LIMIT 200""", also=_IDX + _NUM.format(tf=_ONE.format("cache") + " AS f0", df="count(*) FILTER (WHERE f0 > 0) OVER () AS d0"))
def search_in_repository(spark, root):
    """The 200 best open threads of repository 1 for a word, with their 3 strongest stored neighbours."""
    rows = search_view(spark, root, "cache", 1, limit=200)
    listed = F.array_join(F.transform("neighbors", lambda n: n["thread_id"].cast("string")), ",")
    return rows.select("thread_id", F.round("keyword_score", 6).alias("keyword_score"), F.when(F.size("neighbors") > 0, listed).alias("neighbors"))
