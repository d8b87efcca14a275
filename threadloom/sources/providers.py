"""Pluggable embedding and summary providers, called once per batch inside a task, with retries; and offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Source(Protocol):
    """A client of the place that threads come from: pages of payloads as JSON lines in a folder, and single lookups."""

    def repository(self, owner: str, name: str) -> dict: ...

    def write_listing(self, folder: str, state: str, since: str | None) -> None: ...

    def lookup(self, number: int) -> dict | None: ...


class VectorStore(Protocol):
    """A store of vectors that answers neighbour queries; the exact one works on tables alone."""

    def upsert(self, rows: DataFrame) -> None: ...

    def remove(self, ids: DataFrame) -> None: ...

    def query(self, queries: DataFrame, k: int, floor: float) -> DataFrame: ...


class Provider(Protocol):
    def embed(self, texts: list[str], dimensions: int) -> list[list[float]]: ...

    def summarize(self, texts: list[str]) -> list[dict[str, str]]: ...


class Transient(Exception):
    """A failure that another attempt may not have; ``wait`` is the time in seconds that the source asks for."""

    def __init__(self, message: str = "", wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


class TooLong(Exception):
    """A refusal of a text for its length; the message may give numbers."""


#: Answers that another attempt won't change.
FINAL = (400, 401, 403, 404, 422)


def failure(status: int, headers: dict[str, str], now: float) -> Exception:
    """The exception for an HTTP status: final ones, and all others with the wait that a rate limit asks for.

    A 403 or 429 with a ``retry-after``, or with no requests remaining until ``x-ratelimit-reset``, is a rate limit and no final answer.
    """
    low = {k.lower(): v for k, v in headers.items()}
    if status in (403, 429):
        if "retry-after" in low:
            return Transient(f"status {status}", float(low["retry-after"]))
        if low.get("x-ratelimit-remaining") == "0" and "x-ratelimit-reset" in low:
            return Transient(f"status {status}", max(0.0, float(low["x-ratelimit-reset"]) - now))
    return ValueError(f"status {status}") if status in FINAL else Transient(f"status {status}")


class HashingProvider:
    """Deterministic and offline: signed counts of hashed words, at length 1; the summary is the first line."""

    def embed(self, texts: list[str], dimensions: int) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[(h >> 1) % dimensions] += 1 if h & 1 else -1
            size = np.linalg.norm(row)
            row /= size if size else 1
        return out.tolist()

    def summarize(self, texts: list[str]) -> list[dict[str, str]]:
        return [{"dedupe_summary": (t or "").split("\n", 1)[0]} for t in texts]


def attempt(call: Callable[[], list], tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """Call again after transient failures, waiting twice as long each time; the last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except Transient as e:
            if n == tries - 1:
                raise
            sleep(wait * 2**n if e.wait is None else e.wait)
    return []


#: Tokens that a summary may take in each of its attempts.
SUMMARY_TOKENS = (500, 900, 1400)
SUMMARY_FIELDS = ("problem_summary", "solution_summary", "maintainer_signal_summary", "dedupe_summary")


def parsed_summary(text: str) -> dict[str, str]:
    """The four fields of a JSON answer; a ValueError if one is missing or no text."""
    found = json.loads(text)
    if not isinstance(found, dict) or any(not isinstance(found.get(f), str) for f in SUMMARY_FIELDS):
        raise ValueError("a summary lacks a field")
    return {f: found[f] for f in SUMMARY_FIELDS}


def summary_ladder(ask: Callable[[str, int], tuple[str, dict[str, int]]], text: str) -> tuple[dict[str, str], dict[str, int]]:
    """(fields, usage) of the first answer that can be read, with more room in each attempt; usage of all attempts is added up.

    ``ask(text, tokens)`` gives the answer's JSON and its usage. The last attempt's failure is raised.
    """
    usage: dict[str, int] = {}
    for n, tokens in enumerate(SUMMARY_TOKENS):
        answer, used = ask(text, tokens)
        for k, v in used.items():
            usage[k] = usage.get(k, 0) + v
        try:
            return parsed_summary(answer), usage
        except ValueError:
            if n == len(SUMMARY_TOKENS) - 1:
                raise
    return {}, usage


def shrunk(text: str, message: str, marker: str = "\n\n[truncated for embedding]", least: int = 256) -> str | None:
    """A shorter text after a refusal for length, by the numbers that the message gives; None when it can't shrink further.

    Fixed values: the patterns of the messages, and the bounds 0.1, 0.9 and 0.95 of the share that is kept.
    """
    body = text.removesuffix(marker)
    if len(body) <= least:
        return None
    asked = re.search(r"requested (\d+) tokens", message)
    most = re.search(r"maximum (?:context|input) length is (\d+)", message)
    ratio = min(0.9, max(0.1, int(most[1]) * 0.95 / int(asked[1]))) if asked and most and int(asked[1]) else 0.9
    return body[: max(least, int(len(body) * ratio))].rstrip() + marker


def embedded(provider: Provider, texts: list[str], dimensions: int, tries: int = 5) -> list[list[float]]:
    """Vectors of one request. If a batch is refused for length, its texts go one by one, each shortened until it is accepted, ``tries`` times at most."""
    try:
        return attempt(lambda: provider.embed(texts, dimensions))
    except TooLong:
        if len(texts) > 1:
            return [embedded(provider, [t], dimensions, tries)[0] for t in texts]
    text = texts[0]
    for n in range(tries):
        try:
            return attempt(lambda t=text: provider.embed([t], dimensions))
        except TooLong as e:
            shorter = shrunk(text, str(e))
            if shorter is None or n == tries - 1:
                raise
            text = shorter
    return []


def embed_texts(tasks: DataFrame, provider: Provider, dimensions: int, batch: int = 8) -> DataFrame:
    """``(thread_id, content_hash, vector)`` of ``(thread_id, text, content_hash)``: one provider call per ``batch`` texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, found = part.column(1).to_pylist(), []
            for s in range(0, len(texts), batch):
                found += embedded(provider, texts[s : s + batch], dimensions)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.list_(pa.float32()))], names=["thread_id", "content_hash", "vector"])

    return tasks.select("thread_id", "text", "content_hash").mapInArrow(run, "thread_id long, content_hash string, vector array<float>")


def summarize_texts(tasks: DataFrame, provider: Provider, batch: int = 8) -> DataFrame:
    """``(thread_id, summary_kind, summary_text)`` of ``(thread_id, summary_input)``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            out: list[tuple] = []
            for s in range(0, len(texts), batch):
                for i, kinds in zip(ids[s : s + batch], attempt(lambda s=s: provider.summarize(texts[s : s + batch]))):
                    out += [(i, k, v) for k, v in kinds.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["thread_id", "summary_kind", "summary_text"])

    return tasks.select("thread_id", "summary_input").mapInArrow(run, "thread_id long, summary_kind string, summary_text string")
