"""JSON payload sources: listings, single records and comments, as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_USER = "struct<login:string,type:string>"
#: The payload fields that are read; anything else in a payload is pruned by the reader.
ISSUE = f"id long, number long, state string, title string, body string, html_url string, labels string, assignees string, user {_USER}, pull_request string, draft boolean, created_at string, updated_at string, closed_at string, merged_at string"
COMMENT = f"id long, body string, state string, user {_USER}, created_at string, updated_at string, submitted_at string"


def repository_rows(spark: SparkSession, path: str, pulled_at: str) -> DataFrame:
    """Columns of ``repositories`` from their payloads; a payload without an owner or a name is left out."""
    rows = spark.read.schema("id long, name string, full_name string, owner struct<login:string>, _raw string").option("columnNameOfCorruptRecord", "_raw").json(path)
    rows = rows.where("owner.login is not null and name is not null")
    full = F.coalesce("full_name", F.concat("owner.login", F.lit("/"), "name"))
    return rows.select(F.col("owner.login").alias("owner"), "name", full.alias("full_name"), F.col("id").cast("string").alias("github_repo_id"), F.lit(pulled_at).alias("updated_at"))


def issues(spark: SparkSession, path: str, state: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """A listing, newest first; ``since`` and ``state`` are filters of the scan, ``limit`` takes the newest."""
    rows = spark.read.schema(ISSUE).json(path)
    if state:
        rows = rows.where(F.col("state") == state)
    if since:
        rows = rows.where(F.col("updated_at") >= since)
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), F.col("number").desc()).limit(limit) if limit else rows


def one(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(ISSUE).json(path).where(F.col("number") == number)


def thread_rows(payload: DataFrame, repo_id: int, pulled_at: str) -> DataFrame:
    """Columns of ``threads`` from a listing; a missing title is ``#number``, a missing state ``open``."""
    kind = F.when(F.col("pull_request").isNotNull(), "pull_request").otherwise("issue")
    title = F.coalesce("title", F.concat(F.lit("#"), F.col("number").cast("string")))
    return payload.select(
        F.lit(repo_id).cast("long").alias("repo_id"), F.col("id").cast("string").alias("github_id"), "number", kind.alias("kind"), F.coalesce("state", F.lit("open")).alias("state"), title.alias("title"), "body",
        F.col("user.login").alias("author_login"), F.col("user.type").alias("author_type"), "html_url", F.coalesce("labels", F.lit("[]")).alias("labels_json"), F.coalesce("assignees", F.lit("[]")).alias("assignees_json"),
        F.sha2(F.concat(title, F.lit("\n"), F.coalesce("body", F.lit(""))), 256).alias("content_hash"), F.coalesce("draft", F.lit(False)).cast("int").alias("is_draft"), F.col("created_at").alias("created_at_gh"),
        F.col("updated_at").alias("updated_at_gh"), F.col("closed_at").alias("closed_at_gh"), F.col("merged_at").alias("merged_at_gh"), F.lit(pulled_at).alias("first_pulled_at"), F.lit(pulled_at).alias("last_pulled_at"),
    )


def comments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows of the three kinds of comments; a review without a body shows its state."""
    parts = None
    for kind, path in paths.items():
        body = F.coalesce("body", "state") if kind == "review" else F.col("body")
        rows = spark.read.schema(COMMENT).json(path).select(
            F.lit(kind).alias("comment_type"), F.col("id").cast("string").alias("github_id"), body.alias("body"), F.col("user.login").alias("author_login"), F.col("user.type").alias("author_type"),
            F.coalesce("created_at", "submitted_at").alias("created_at_gh"), F.coalesce("updated_at", "submitted_at").alias("updated_at_gh"),
        )
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        raise ValueError("no kind of comments is given")
    return parts
