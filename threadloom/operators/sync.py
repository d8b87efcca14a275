"""Keeping the stored threads in step with the source: kinds of scans, closed listings, reconciliation, comments, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.merge import replace_children, stale_open

NOT_FOUND = ("404", "410", "Not Found", "Gone")  # fixed values: answers that mean that a thread is gone


def scan_kind(limit: Column, since: Column, reference: Column, effective: Column) -> Column:
    """``full`` without limit, start and reference; ``overlapping`` if it starts no later than the reference; else ``non-overlapping``."""
    full = limit.isNull() & since.isNull() & reference.isNull()
    overlapping = limit.isNull() & reference.isNotNull() & effective.isNotNull() & (effective <= reference)
    return F.when(full, "full").when(overlapping, "overlapping").otherwise("non-overlapping")


def _written(threads: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """``threads`` with ``columns`` taken from the row of ``updates`` of the same id, where there is one."""
    new = updates.select(F.col("id").alias("__id"), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
    rows = threads.join(new, F.col("id") == F.col("__id"), "left")
    return rows.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in threads.columns))


def closed_updates(threads: DataFrame, listing: DataFrame, crawl_start: str, now: str) -> DataFrame:
    """``(id, state, closed_at_gh, updated_at_gh, last_pulled_at)`` of stale open threads that a listing of recently closed ones
    ``(repo_id, number, state, closed_at_gh, updated_at_gh)`` has under the same number, whatever the kind; of several the closed last one counts."""
    newest = F.max_by(F.struct("state", "closed_at_gh", "updated_at_gh"), F.struct(F.coalesce("closed_at_gh", F.lit("")), F.coalesce("updated_at_gh", F.lit(""))))
    per = listing.where("number is not null").groupBy("repo_id", "number").agg(newest.alias("seen"))
    hit = stale_open(threads, crawl_start).join(per, ["repo_id", "number"])
    return hit.select("id", F.col("seen.state").alias("state"), "seen.closed_at_gh", F.coalesce("seen.updated_at_gh", "updated_at_gh").alias("updated_at_gh"), F.lit(now).alias("last_pulled_at"))


def reconciled_updates(threads: DataFrame, answers: DataFrame, crawl_start: str, now: str) -> DataFrame:
    """The same columns for every stale open thread that was looked up: ``answers`` ``(repo_id, number, state, closed_at_gh, updated_at_gh,
    error)``, one a thread. A thread without an answer, or with one that says that it is gone, is closed as of now unless a
    time is known; any other error leaves it out, to be looked up again.
    """
    stale = stale_open(threads, crawl_start).select("id", "repo_id", "number", F.col("closed_at_gh").alias("was"), F.col("updated_at_gh").alias("before"))
    both = stale.join(answers.withColumn("answered", F.lit(True)), ["repo_id", "number"], "left")
    gone = F.col("answered").isNull() | F.coalesce(F.col("error").isin(*NOT_FOUND), F.lit(False))
    known = both.withColumn("gone", gone).where(F.col("gone") | F.col("error").isNull())
    closed = F.when(F.col("gone"), F.coalesce("was", F.lit(now))).otherwise(F.col("closed_at_gh"))
    return known.select("id", F.when(F.col("gone"), "closed").otherwise(F.col("state")).alias("state"), closed.alias("closed_at_gh"), F.when(F.col("gone"), F.col("before")).otherwise(F.coalesce("updated_at_gh", "before")).alias("updated_at_gh"), F.lit(now).alias("last_pulled_at"))


def apply_updates(threads: DataFrame, updates: DataFrame) -> DataFrame:
    return _written(threads, updates, [c for c in updates.columns if c != "id"])


def hydrate(comments: DataFrame, incoming: DataFrame, threads: DataFrame) -> DataFrame:
    """Comments of the ``threads`` (their ids) that were read again are replaced by the incoming ones, so deleted ones go; others stay."""
    kept = comments.join(threads.select(F.col("id").alias("thread_id")).distinct(), "thread_id", "left_anti")
    return replace_children(kept.select(*comments.columns), incoming.select(*comments.columns), "thread_id")


def purge_comments(comments: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comments left, ``(thread_id, purged)`` of the ``threads`` with those that go, 0 included)."""
    ids = threads.select(F.col("id").alias("thread_id")).distinct()
    gone = comments.join(ids, "thread_id", "left_semi").groupBy("thread_id").agg(F.count("*").alias("n"))
    return comments.join(ids, "thread_id", "left_anti").select(*comments.columns), ids.join(gone, "thread_id", "left").select("thread_id", F.coalesce("n", F.lit(0)).alias("purged"))


CURSORS = ("last_full_open_scan_started_at", "last_overlapping_open_scan_completed_at", "last_non_overlapping_scan_completed_at", "last_open_close_reconciled_at")
RUN_STATS = "crawl_started_at string, is_full_open_scan boolean, is_overlapping_open_scan boolean, reconciled_open_close_at string"


def derived_cursors(runs: DataFrame) -> DataFrame:
    """``repo_id`` and the four cursors, each from the newest completed run that has it. ``runs``: ``(id, repo_id, status, finished_at,
    stats)`` with ``stats`` as JSON; runs without readable statistics are left out."""
    s = F.from_json("stats", RUN_STATS)
    rows = runs.where("status = 'completed' and stats is not null").withColumn("s", s).where("s is not null and (s.crawl_started_at is not null or s.is_full_open_scan is not null or s.is_overlapping_open_scan is not null or s.reconciled_open_close_at is not null)")
    full, over = F.coalesce("s.is_full_open_scan", F.lit(False)), F.coalesce("s.is_overlapping_open_scan", F.lit(False))
    values = (F.when(full, F.col("s.crawl_started_at")), F.when(over, F.col("finished_at")), F.when(~full & ~over, F.col("finished_at")), F.col("s.reconciled_open_close_at"))
    return rows.groupBy("repo_id").agg(*(F.max_by(v, F.when(v.isNotNull(), F.col("id"))).alias(c) for c, v in zip(CURSORS, values)))


def cursors(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored cursors, and those derived from runs for repositories that have none stored."""
    new = derived_cursors(runs).join(stored.select("repo_id"), "repo_id", "left_anti")
    return stored.select("repo_id", *CURSORS).unionByName(new.select("repo_id", *CURSORS))
