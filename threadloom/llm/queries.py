"""Queries of the operators for training data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.bpe import token_counts, token_ids
from threadloom.llm.grid import groups
from threadloom.llm.knn import nearest, similar_pairs
from threadloom.llm.omh import member_pairs, near_duplicates
from threadloom.llm.oracles import ORACLES  # noqa: F401
from threadloom.llm.packing import pack
from threadloom.llm.pivot import clusters, isolated_clusters
from threadloom.llm.spans import passages, shared_amounts
from threadloom.llm.split import split_texts
from threadloom.llm.vectors import usable_vectors
from threadloom.operators.edges import neighbors_of
from threadloom.operators.latest import latest
from threadloom.operators.vectors import from_binary
from threadloom.session import Scratch, tune
from threadloom.sources.tables import table

MODEL = "trellis-embed-l"


def thread_vectors(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "thread_vectors").where(F.col("model") == MODEL)
    return usable_vectors(rows, F.lit("thread_vectors"), "thread_id", "vector_json", "dimensions", "updated_at")


def all_vectors(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "document_embeddings").where(F.col("model") == MODEL)
    return thread_vectors(spark, root).unionAll(usable_vectors(rows, F.col("source_kind"), "thread_id", "embedding_json", "dimensions", "updated_at"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of which one is among the other's 6 most similar threads, at a cosine of 0.82 or more."""
    tune(spark, 8000)
    edges, _ = nearest(all_vectors(spark, root), 6, 0.82, Scratch(spark), target=0.998)
    return similar_pairs(edges).select(F.regexp_replace("vset", "#[0-9]+$", "").alias("vector_set"), F.col("left_id").alias("left_thread_id"), F.col("right_id").alias("right_thread_id"))


def p2_recall(spark: SparkSession, root: str) -> DataFrame:
    """For every thread whose id is divisible by 50, all rows held against it exactly: its 6 most similar at 0.82 or more, how many pairs
    they are in each set, and whether the tree search gives at least 0.9 of them."""
    tune(spark, 8000)
    scratch = Scratch(spark)
    rows = scratch.save(all_vectors(spark, root), "all")
    edges, _ = nearest(rows, 6, 0.82, Scratch(spark), target=0.998)
    exact = from_binary(rows, "vec").select(F.col("vset").alias("scope"), "id", F.col("vec").cast("array<double>").alias("vec"))
    want = scratch.save(neighbors_of(exact.where("id % 50 = 0"), exact, 6, 0.82).select(F.col("scope").alias("vset"), "left_id", "right_id"), "exact")
    got = edges.where("left_id % 50 = 0").select("vset", "left_id", "right_id", F.lit(1).alias("hit"))
    per = want.join(got, ["vset", "left_id", "right_id"], "left").groupBy(F.regexp_replace("vset", "#[0-9]+$", "").alias("vector_set"))
    return per.agg(F.count("*").alias("exact_pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of every text above 6,000 characters, with 300 characters of overlap."""
    tune(spark, 200)
    threads = latest(table(spark, root, "threads").select("id", "body", "updated_at"), ["id"], "updated_at", "body")
    documents = table(spark, root, "documents").where("doc_id is not null")
    parts = [
        split_texts(rows, ident, text, 6000, 300).select(F.lit(name).alias("item_table"), F.col(ident).alias("item_id"), "boundary", "piece", "start", "end", "content")
        for name, rows, ident, text in (("threads", threads, "id", "body"), ("documents", documents, "doc_id", "raw_text"))
    ]
    return parts[0].unionAll(parts[1])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The boundary at which each text above 6,000 characters can be cut."""
    return p3_pieces(spark, root).where("piece = 0").select("item_table", "item_id", "boundary")


def p3_cover(spark: SparkSession, root: str) -> DataFrame:
    """Characters of each split text that its pieces cover, and whether all pieces keep to the limit and share 0 to 300 characters with the one before."""
    before = F.lag("end", 1, 0).over(Window.partitionBy("item_table", "item_id").orderBy("piece"))
    rows = p3_pieces(spark, root).select("item_table", "item_id", "start", "end", before.alias("before"), F.length("content").alias("n"))
    new = F.col("end") - F.greatest("start", "before")
    fits = (F.col("n") <= 6000) & (F.col("n") == F.col("end") - F.col("start"))
    laps = (F.col("start") <= F.col("before")) & (F.col("before") - F.col("start") <= 300)
    return rows.groupBy("item_table", "item_id").agg(F.sum(new).alias("covered"), F.bool_and(fits).alias("within"), F.bool_and(laps).alias("lapped"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The group of every thread with a link of score 0.78 to 1."""
    tune(spark)
    links = table(spark, root, "similarity_edges").where("score >= 0.78 and score <= 1").select("left_thread_id", "right_thread_id")
    return groups(links, "left_thread_id", "right_thread_id", Scratch(spark)).select(F.col("group_id").alias("group_thread_id"), F.col("member_id").alias("thread_id"))


def p4_group_sizes(spark: SparkSession, root: str) -> DataFrame:
    """How many groups there are of each size."""
    return p4_found(spark, root).groupBy("group_thread_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def _filed_texts(spark: SparkSession, root: str) -> DataFrame:
    """Title and body of the current row of every thread, and every document's text for comparison."""
    threads = latest(table(spark, root, "threads").select("id", "title", "body", "updated_at"), ["id"], "updated_at", "title", "body")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    documents = table(spark, root, "documents").select(F.lit("documents").alias("name"), F.col("doc_id").alias("id"), F.col("dedupe_text").alias("text"))
    return threads.select(F.lit("threads").alias("name"), "id", text.alias("text")).unionAll(documents)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of threads, and of documents, whose word triples agree to 0.6 or more."""
    tune(spark)
    pairs, members = near_duplicates(_filed_texts(spark, root), 0.6, Scratch(spark))
    return member_pairs(pairs, members).select(F.col("name").alias("record_table"), "left_id", "right_id")


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row per record that has a near duplicate: its group, and the number of different texts that it is linked to."""
    tune(spark)
    scratch = Scratch(spark)
    pairs, members = near_duplicates(_filed_texts(spark, root), 0.6, scratch)
    pairs, members = scratch.save(pairs, "pairs"), scratch.save(members, "members")
    linked = groups(pairs, "a", "b", Scratch(spark))
    links = pairs.select(F.explode(F.array("a", "b")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("kind").agg(F.count("*").alias("n_copies"))
    found = members.join(copies, "kind").join(links, "kind", "left").join(linked.withColumnRenamed("member_id", "kind"), "kind", "left").where("n_copies > 1 or n_links > 0")
    named = found.withColumn("g", F.coalesce("group_id", "kind"))
    least = named.groupBy("g").agg(F.min("id").alias("group_record_id"))
    return named.join(least, "g").select(F.col("name").alias("record_table"), F.col("id").alias("record_id"), "group_record_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of 4 or more threads that are all alike, at a cosine of 0.80, and like no other."""
    tune(spark, 8000)
    found = isolated_clusters(thread_vectors(spark, root), 0.80, 4, Scratch(spark))
    return found.select(F.col("representative_id").alias("representative_thread_id"), F.col("id").alias("thread_id"))


def p6_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Every cluster of two or more threads with its size and its three most typical members."""
    tune(spark, 8000)
    return clusters(thread_vectors(spark, root), 0.80, Scratch(spark))


def tokenizer_path() -> str:
    """Where the public vocabulary lies; ``THREADLOOM_TOKENIZERS`` names another folder."""
    return f"{os.environ.get('THREADLOOM_TOKENIZERS', '/opt/tokenizers')}/byte_bpe_50k.json"


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document's text."""
    tune(spark)
    return token_ids(table(spark, root, "documents"), "doc_id", "text", tokenizer_path())


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of 2,048 tokens of every document, or of every piece of a larger one."""
    tune(spark)
    sizes = Scratch(spark).save(token_counts(table(spark, root, "documents"), "doc_id", "text", tokenizer_path()), "sizes")
    placed = pack(sizes, "doc_id", "n_tokens", 2048)
    return placed.select("doc_id", "piece", "container_id", F.col("first_unit").alias("first_token"), F.col("n_units").alias("n_tokens"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers by the share of their room that is used, in hundredths."""
    used = p8_containers(spark, root).where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return used.groupBy(F.floor(F.col("n") * 100 / 2048).cast("int").alias("filled_percent")).agg(F.count("*").alias("n_containers"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Characters of each document in spans of 150 or more that another document has as well."""
    tune(spark)
    return shared_amounts(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text", 150, Scratch(spark)).select(F.col("doc").alias("doc_id"), "shared_chars")


def p9_passages(spark: SparkSession, root: str) -> DataFrame:
    """Passages of 150 or more matched characters that two documents share up to edits: one row per aligned chain of exact spans, with
    its identity; one for each further document of an equal text, and the class of passages that each row belongs to."""
    tune(spark)
    found = passages(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text", 150, Scratch(spark))
    names = {"a": "left_id", "b": "right_id", "chain": "chain", "start_a": "left_start", "end_a": "left_end", "start_b": "right_start", "end_b": "right_end", "n_spans": "n_spans", "matched": "matched_chars", "identity": "identity", "class_id": "class_id"}
    return found.select(*(F.col(c).alias(n) for c, n in names.items()))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_recall, p3_found, p3_pieces, p3_cover, p4_found, p4_group_sizes, p5_found, p5_groups, p6_found, p6_clusters, p7_ids, p8_containers, p8_fill, p9_found, p9_passages)
}
