"""The stages of a refresh over a snapshot store: sync, summaries, vectors, clusters; maintenance and local close actions.

Every stage works on one repository and leaves the rows of the others as they are. A run is logged when it starts and when it
ends, so the log is append-only and a run's state is its last row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import CLUSTER_K, CLUSTER_MIN_SCORE, EMBED_BASIS, EMBED_MODEL, PROMPT_VERSION
from threadloom.functions.vectors import unit
from threadloom.operators import clustering, edges, state, sync
from threadloom.operators.documents import canonical_documents, summary_sources
from threadloom.operators.merge import SnapshotStore, numbered
from threadloom.plans.model import is_closed, is_open
from threadloom.session import Scratch
from threadloom.sources.providers import Provider, embed_texts, summarize_texts

THREAD_KEY = ["repo_id", "kind", "number"]
COMMENTS = "id long, thread_id long, github_id string, comment_type string, body string, author_login string, author_type string, is_bot int, created_at_gh string, updated_at_gh string"
RUNS = "id long, kind string, repo_id long, status string, at string, stats string, error string"
SUMMARIES = "thread_id long, summary_kind string, summary_text string, content_hash string, prompt_version string"
CURSORS = "repo_id long, " + ", ".join(f"{c} string" for c in sync.CURSORS)
STATE = "repo_id long, summary_model string, summary_prompt_version string, embedding_basis string, embed_model string, embed_dimensions int, embed_pipeline_version string, vector_backend string, vectors_current_at string, clusters_current_at string"


class Pipeline:
    """One corpus in a store; ``now`` is given by the caller, so that every run can be repeated."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, basis: str = EMBED_BASIS, summary_model: str = "") -> None:
        self.spark, self.store, self.basis, self.summary_model = spark, store, basis, summary_model

    # tables and the log

    def table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.version(name) else self.spark.createDataFrame([], schema)

    def comments(self) -> DataFrame:
        return self.table("comments", COMMENTS)

    def _append(self, name: str, schema: str, row: tuple) -> None:
        self.store.write(name, self.table(name, schema).unionByName(self.spark.createDataFrame([row], schema)))

    @contextmanager
    def run(self, kind: str, repo_id: int, now: str) -> Iterator[dict]:
        """A logged run; what is put into the dictionary are its statistics, its id is there as ``run``. A failure is logged and raised."""
        number = 1 + (self.table("runs", RUNS).agg(F.max("id")).first()[0] or 0)
        self._append("runs", RUNS, (number, kind, repo_id, "running", now, None, None))
        stats: dict = {"run": number}
        try:
            yield stats
        except Exception as e:
            self._append("runs", RUNS, (number, kind, repo_id, "failed", now, json.dumps(stats), str(e)[:2000]))
            raise
        self._append("runs", RUNS, (number, kind, repo_id, "completed", now, json.dumps(stats), None))

    def latest_run(self, kind: str, repo_id: int) -> int | None:
        """The latest completed run of a kind."""
        return self.table("runs", RUNS).where((F.col("kind") == kind) & (F.col("repo_id") == repo_id) & (F.col("status") == "completed")).agg(F.max("id")).first()[0]

    def _mark(self, repo_id: int, now: str, dimensions: int, clusters: bool) -> None:
        """Vectors, or clusters too, are as they would be made now; new vectors make the clusters out of date."""
        rows = self.table("pipeline_state", STATE)
        stamps = state.desired_stamps(self.summary_model, self.basis, dimensions=dimensions)
        before = rows.where(F.col("repo_id") == repo_id).first()
        vectors = (before["vectors_current_at"] if clusters and before else None) or now
        row = self.spark.createDataFrame([(repo_id, *stamps.values(), vectors, now if clusters else None)], STATE)
        self.store.write("pipeline_state", rows.where(F.col("repo_id") != repo_id).unionByName(row))

    def current(self, repo_id: int, dimensions: int) -> tuple[bool, bool]:
        """Whether the repository's vectors, and its clusters, are current."""
        row = state.currency(self.table("pipeline_state", STATE), state.desired_stamps(self.summary_model, self.basis, dimensions=dimensions)).where(F.col("repo_id") == repo_id).first()
        return (row["vectors_current"], row["clusters_current"]) if row else (False, False)

    # sync

    def sync(self, threads: DataFrame, comments: DataFrame | None, repo_id: int, now: str, since: str | None = None, limit: int | None = None) -> int:
        """Merge payload rows of one repository; pull start and local close of known threads stay. ``comments`` replace those of the
        threads that came in. The documents of these threads are built anew, and the cursors move on."""
        with self.run("sync", repo_id, now) as stats:
            threads = threads.where(F.col("repo_id") == repo_id)
            none = F.lit(None).cast("string")
            if self.store.version("threads") is None:
                rows = numbered(threads, "id", 0, F.col("number"), F.col("kind"))
            else:
                known = self.store.read("threads")
                ids = threads.join(known.select(*THREAD_KEY, "id"), THREAD_KEY, "left")
                top = known.agg(F.max("id")).first()[0] or 0
                # new threads are numbered behind the known ones; only they are ordered
                fresh = numbered(ids.where("id is null").drop("id"), "id", top, F.col("number"), F.col("kind"))
                rows = ids.where("id is not null").unionByName(fresh)
            rows = Scratch(self.spark).save(rows.withColumn("closed_at_local", none).withColumn("close_reason_local", none), "incoming")
            self.store.merge("threads", rows, THREAD_KEY, preserve=["id", "first_pulled_at", "closed_at_local", "close_reason_local"])
            touched = self.store.read("threads").join(rows.select(*THREAD_KEY), THREAD_KEY, "left_semi").select("id")
            if comments is not None:
                self.store.write("comments", sync.hydrate(self.comments(), comments, touched))
                stats["comments_synced"] = comments.count()
            stats["threads_synced"] = rows.count()
            self.refresh_documents(Scratch(self.spark).save(touched, "touched"))
            reference = self._reference(repo_id)
            kind = self.spark.range(1).select(sync.scan_kind(*(F.lit(v).cast("string") for v in (limit, since, reference, since)))).first()[0]
            stats |= {"crawl_started_at": now, "is_full_open_scan": kind == "full", "is_overlapping_open_scan": kind == "overlapping"}
        self.save_cursors(now)
        return stats["run"]

    def _reference(self, repo_id: int) -> str | None:
        row = self.table("cursors", CURSORS).where(F.col("repo_id") == repo_id).first()
        return row and (row["last_overlapping_open_scan_completed_at"] or row["last_full_open_scan_started_at"])

    def save_cursors(self, now: str) -> None:
        """Cursors of all repositories from the log: what the newest completed runs say goes over what is stored."""
        runs = self.table("runs", RUNS).where("kind = 'sync'").withColumnRenamed("at", "finished_at")
        new, old = sync.derived_cursors(runs).alias("n"), self.table("cursors", CURSORS).alias("o")
        both = old.join(new, F.col("o.repo_id") == F.col("n.repo_id"), "full")
        self.store.write("cursors", both.select(F.coalesce("n.repo_id", "o.repo_id").alias("repo_id"), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in sync.CURSORS)))

    def refresh_documents(self, ids: DataFrame) -> None:
        """Build the documents of these threads anew, and write their hashes into the threads."""
        threads = self.store.read("threads")
        mine = threads.join(ids, "id", "left_semi")
        talk = self.comments().join(ids.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
        made = Scratch(self.spark).save(canonical_documents(mine, talk), "documents")
        self.store.merge("documents", made, ["thread_id"])
        hashes = made.select(F.col("thread_id").alias("id"), "content_hash")
        self.store.write("threads", sync.apply_updates(threads, hashes))

    def sweep(self, listing: DataFrame, repo_id: int, crawl_start: str, now: str) -> int:
        """Close stale open threads that a listing of closed ones has; how many there were."""
        return self._update(sync.closed_updates(self._mine(repo_id), listing, crawl_start, now), repo_id, now)

    def reconcile_all(self, answers: DataFrame, repo_id: int, crawl_start: str, now: str) -> int:
        """Look at every stale open thread by itself; how many were closed or updated."""
        return self._update(sync.reconciled_updates(self._mine(repo_id), answers, crawl_start, now), repo_id, now)

    def _mine(self, repo_id: int) -> DataFrame:
        return self.store.read("threads").where(F.col("repo_id") == repo_id)

    def _update(self, updates: DataFrame, repo_id: int, now: str) -> int:
        with self.run("sync", repo_id, now) as stats:
            found = Scratch(self.spark).save(updates, "updates")
            stats |= {"threads_closed": found.where("state <> 'open'").count(), "reconciled_open_close_at": now}
            self.store.write("threads", sync.apply_updates(self.store.read("threads"), found))
        self.reconcile(now)
        return stats["threads_closed"]

    def purge_comments(self, repo_id: int, now: str) -> int:
        """Drop all comments of a repository and build its documents anew; how many went."""
        with self.run("purge", repo_id, now) as stats:
            ids = Scratch(self.spark).save(self._mine(repo_id).select("id"), "ids")
            left, gone = sync.purge_comments(self.comments(), ids)
            stats["purged"] = gone.agg(F.sum("purged")).first()[0] or 0
            self.store.write("comments", left)
            self.refresh_documents(ids)
        return stats["purged"]

    # summaries and vectors

    def summarize(self, provider: Provider, repo_id: int, now: str, with_comments: bool = False) -> int:
        """Summarise the open threads whose text or prompt changed; how many there were."""
        with self.run("summarize", repo_id, now) as stats:
            sources = summary_sources(self._mine(repo_id).where("state = 'open'"), self.comments(), with_comments)
            known = self.table("summaries", SUMMARIES)
            todo = Scratch(self.spark).save(state.pending_summaries(sources, known.where("summary_kind = 'dedupe_summary'")), "todo")
            made = summarize_texts(todo, provider).join(todo.select("thread_id", "content_hash"), "thread_id").withColumn("prompt_version", F.lit(PROMPT_VERSION))
            made = Scratch(self.spark).save(made, "summaries")
            stats["summarized"] = todo.count()
            self.store.merge("summaries", made.select("thread_id", "summary_kind", "summary_text", "content_hash", "prompt_version"), ["thread_id", "summary_kind"])
        return stats["summarized"]

    def embed(self, provider: Provider, dimensions: int, repo_id: int, now: str) -> int:
        """Embed the open threads whose text changed, or all of them if the vectors were made otherwise; vectors of the repository's
        closed threads are dropped. The number of new vectors."""
        with self.run("embed", repo_id, now) as stats:
            threads = self.store.read("threads")
            open_ = self._mine(repo_id).where(is_open())
            schema = "thread_id long, content_hash string, vector array<float>"
            stored = self.table("thread_vectors", schema)
            made = self.table("summaries", SUMMARIES).where("summary_kind = 'dedupe_summary'") if self.basis == "title_summary" else None
            tasks, missing = state.workset(open_, made, stored, self.basis, self.current(repo_id, dimensions)[0], EMBED_MODEL, dimensions)
            state.require_summaries(missing)
            new = Scratch(self.spark).save(embed_texts(tasks, provider, dimensions), "embedded")
            stats["embedded"] = new.count()
            others = state.without_repository(stored, threads, repo_id)
            kept = state.active_vectors(stored, open_).join(new.select("thread_id"), "thread_id", "left_anti").select("thread_id", "content_hash", "vector")
            self.store.write("thread_vectors", others.unionByName(kept).unionByName(new.select("thread_id", "content_hash", "vector")))
            if stats["embedded"] or not self.current(repo_id, dimensions)[0]:
                self._mark(repo_id, now, dimensions, clusters=False)
        return stats["embedded"]

    def reset_vectors(self, repo_id: int) -> None:
        """Drop a repository's vectors, and with them the mark that they are current."""
        self.store.write("thread_vectors", state.without_repository(self.store.read("thread_vectors"), self.store.read("threads"), repo_id))
        self.store.write("pipeline_state", self.table("pipeline_state", STATE).where(F.col("repo_id") != repo_id))

    # clusters

    def cluster(self, repo_id: int, now: str, k: int = CLUSTER_K, floor: float = CLUSTER_MIN_SCORE) -> int:
        """Build and persist a repository's run: edges, clusters and members with their scores; it takes the place of the one before."""
        scratch = Scratch(self.spark)
        with self.run("cluster", repo_id, now) as stats:
            open_ = self._mine(repo_id).where(is_open())
            vecs = scratch.save(self.store.read("thread_vectors").join(open_.select(F.col("id").alias("thread_id"), "number"), "thread_id"), "vectors")
            found = edges.knn_edges(vecs.select(F.lit(str(repo_id)).alias("scope"), F.col("thread_id").alias("id"), unit(F.col("vector")).alias("vec")), k, floor)
            eg = scratch.save(found.select("left_id", "right_id", "score"), "edges")
            nodes = vecs.select(F.col("thread_id").alias("id"), "number")
            comp = scratch.save(clustering.connected_components(nodes, eg, scratch), "components")
            reps = clustering.representatives(comp, eg, nodes)
            rest = {n: self.store.read(n).where(F.col("repo_id") != repo_id) if self.store.version(n) else None for n in ("similarity_edges", "clusters", "cluster_members")}
            top = (rest["clusters"].agg(F.max("id")).first()[0] or 0) if rest["clusters"] is not None else 0
            ids = scratch.save(clustering.ordered(comp, nodes).join(reps.select("component", "representative_id"), "component").withColumn("id", F.col("place") + top), "ids")
            run, repo, none = F.lit(stats["run"]).cast("long"), F.lit(repo_id).cast("long"), F.lit(None).cast("string")
            explanation = F.to_json(F.struct(F.array(F.lit("dedupe_summary")).alias("sources"), F.lit(EMBED_MODEL).alias("model")))
            made = {
                "similarity_edges": eg.select(repo.alias("repo_id"), run.alias("cluster_run_id"), "left_id", "right_id", F.lit("exact_cosine").alias("method"), "score", explanation.alias("explanation_json"), F.lit(now).alias("created_at")),
                "clusters": ids.select("id", repo.alias("repo_id"), run.alias("cluster_run_id"), "representative_id", F.col("size").alias("member_count"), none.alias("closed_at_local"), none.alias("close_reason_local")),
                "cluster_members": clustering.member_scores(comp, reps, eg).join(ids.select("component", F.col("id").alias("cluster_id")), "component").select(repo.alias("repo_id"), "cluster_id", F.col("id").alias("thread_id"), "score_to_representative"),
            }
            for name, rows in made.items():
                self.store.write(name, rows if rest[name] is None else rest[name].unionByName(rows))
            stats |= {"edges": eg.count(), "clusters": ids.count()}
            row = self.table("pipeline_state", STATE).where(F.col("repo_id") == repo_id).first()
            if row:
                self._mark(repo_id, now, row["embed_dimensions"], clusters=True)
        return stats["run"]

    def close_thread(self, repo_id: int, number: int, now: str) -> bool:
        """Close a thread here, whatever its kind; whether a cluster's close state changed by it. An unknown number raises a LookupError."""
        threads = self.store.read("threads")
        hit = (F.col("repo_id") == repo_id) & (F.col("number") == number)
        if threads.where(hit).isEmpty():
            raise LookupError(f"no thread {number}")
        self.store.write("threads", threads.withColumn("closed_at_local", F.when(hit, F.lit(now)).otherwise(F.col("closed_at_local"))).withColumn("close_reason_local", F.when(hit, "manual").otherwise(F.col("close_reason_local"))))
        return self.reconcile(now)

    def close_cluster(self, cluster_id: int, now: str) -> None:
        """Close a cluster of its repository's latest run by hand; any other raises a LookupError."""
        rows = self.store.read("clusters")
        row = rows.where(F.col("id") == cluster_id).first()
        if row is None or row["cluster_run_id"] != self.latest_run("cluster", row["repo_id"]):
            raise LookupError(f"no cluster {cluster_id} in the latest run")
        hit = F.col("id") == cluster_id
        self.store.write("clusters", rows.withColumn("closed_at_local", F.when(hit, F.lit(now)).otherwise(F.col("closed_at_local"))).withColumn("close_reason_local", F.when(hit, "manual").otherwise(F.col("close_reason_local"))))

    def reconcile(self, now: str) -> bool:
        """Clusters whose members are all closed are closed, others that were closed so are opened; manual ones stay."""
        if self.store.version("clusters") is None:
            return False
        closed = self.store.read("cluster_members").join(self.store.read("threads").select(F.col("id").alias("thread_id"), is_closed().alias("gone")), "thread_id").groupBy(F.col("cluster_id").alias("id")).agg(F.bool_and("gone").alias("all_gone"))
        rows = self.store.read("clusters").join(closed, "id", "left")
        gone, by_hand = F.coalesce("all_gone", F.lit(False)), F.coalesce(F.col("close_reason_local") == "manual", F.lit(False))
        derived = F.coalesce(F.col("close_reason_local") == "all_members_closed", F.lit(False))
        at = F.when(by_hand, F.col("closed_at_local")).when(gone, F.coalesce("closed_at_local", F.lit(now))).when(derived, F.lit(None)).otherwise(F.col("closed_at_local"))
        reason = F.when(by_hand, "manual").when(gone, "all_members_closed").when(derived, F.lit(None)).otherwise(F.col("close_reason_local"))
        touched = not rows.where(~by_hand & (gone != derived)).isEmpty()
        self.store.write("clusters", rows.withColumn("closed_at_local", at).withColumn("close_reason_local", reason).drop("all_gone"))
        return touched

    # all together

    def refresh(self, repo_id: int, now: str, payload: DataFrame | None = None, comments: DataFrame | None = None, provider: Provider | None = None, dimensions: int = 0, cluster: bool = True) -> dict[str, int | None]:
        """The selected stages in their fixed order; at least one must be selected. Summaries are made if vectors are, and are based on them."""
        if payload is None and provider is None and not cluster:
            raise ValueError("at least one stage must be selected")
        return {
            "sync": self.sync(payload, comments, repo_id, now) if payload is not None else None,
            "summarize": self.summarize(provider, repo_id, now) if provider is not None and self.basis == "title_summary" else None,
            "embed": self.embed(provider, dimensions, repo_id, now) if provider is not None else None,
            "cluster": self.cluster(repo_id, now) if cluster else None,
        }

    def rerun(self, stage: str, repo_id: int, now: str, provider: Provider | None = None, dimensions: int = 0) -> dict[str, int | str]:
        """One stage again, with a message about what it did."""
        if stage not in ("summarize", "embed", "cluster"):
            raise ValueError(f"no stage {stage}")
        if stage != "cluster" and provider is None:
            raise ValueError(f"{stage} needs a provider")
        n = self.summarize(provider, repo_id, now) if stage == "summarize" else self.embed(provider, dimensions, repo_id, now) if stage == "embed" else self.cluster(repo_id, now)
        return {"stage": stage, "result": n, "message": f"run {n} of cluster" if stage == "cluster" else f"{n} threads of {stage}"}

    def doctor(self) -> dict[str, str | bool | int]:
        """Whether Spark answers and the store can be read, and the versions of its tables."""
        tables = ("threads", "comments", "documents", "summaries", "thread_vectors", "similarity_edges", "clusters", "cluster_members", "runs")
        found = {f"table_{n}": v for n in tables if (v := self.store.version(n)) is not None}
        return {"ok": self.spark.range(3).count() == 3, "spark": self.spark.version, **found}
