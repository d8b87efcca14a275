"""Constants of the engine, in one place."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Fixed values that results depend on.
CLUSTER_K, CLUSTER_MIN_SCORE = 6, 0.78
MAX_CLUSTER_SIZE, REFINE_STEP = 200, 0.02
SEARCH_LIMIT, SEMANTIC_FLOOR, HIT_NEIGHBORS = 20, 0.2, 3
NEIGHBOR_LIMIT, NEIGHBOR_FLOOR, STORED_NEIGHBORS = 10, 0.2, 8
SNIPPET_CHARS = 280
CHARS_PER_TOKEN, ITEM_TOKENS, BATCH_TOKENS, BATCH_ITEMS = 3, 7000, 250_000, 8
TRUNCATION_MARKER = "\n\n[truncated for embedding]"
PIPELINE_VERSION, PROMPT_VERSION, EMBED_MODEL, EMBED_DIMENSIONS, EMBED_BASIS = "vectorlite-1024-v1", "v1", "text-embedding-3-large", 1024, "title_original"
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Fusion:
    """How the scores of several sources make one edge score."""

    mode: str = "max"  # max, mean, weighted, min-of-2, boost
    weights: dict[str, float] = field(default_factory=lambda: {"dedupe_summary": 0.5, "title": 0.3, "body": 0.2})
    other_weight: float = 0.1
    bonus: float = 0.05


#: Settings that may come from outside, with their defaults.
SETTINGS = {"root": "", "store": "", "port": 5179, "embed_model": EMBED_MODEL, "embed_basis": EMBED_BASIS, "summary_model": "", "tokenizers": "/opt/tokenizers"}
PREFIX = "THREADLOOM_"


def settings(env: Mapping[str, str], file: str = "", dotenv: str = "") -> dict[str, tuple[str | int, str]]:
    """Each setting with its value and where it is from: ``env``, ``file`` (JSON), ``dotenv`` (lines of NAME=value), or ``default``.

    Blank values count as not set. A file that is missing has no settings; one that is no JSON object raises a ValueError.
    """
    stored: dict = {}
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            stored = json.load(f)
        if not isinstance(stored, dict):
            raise ValueError(f"{file} is no JSON object")
    local: dict[str, str] = {}
    if dotenv and os.path.exists(dotenv):
        with open(dotenv, encoding="utf-8") as f:
            for line in f:
                name, sep, value = line.strip().removeprefix("export ").partition("=")
                if sep and not name.startswith("#"):
                    local[name.strip()] = value.strip().strip("\"'")
    out: dict[str, tuple[str | int, str]] = {}
    for name, default in SETTINGS.items():
        layers = ((env.get(PREFIX + name.upper()), "env"), (stored.get(name), "file"), (local.get(PREFIX + name.upper()), "dotenv"))
        value, origin = next(((v, o) for v, o in layers if v is not None and str(v).strip()), (default, "default"))
        out[name] = (type(default)(value), origin)
    return out


def save_preferences(file: str, values: Mapping[str, object]) -> None:
    """Write preferences over those of the file, as a whole and readable by the owner only."""
    before: dict = {}
    if os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            before = json.load(f)
    os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
    staged = f"{file}.new"
    with open(os.open(staged, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump({**before, **values}, f, indent=2, sort_keys=True)
    os.replace(staged, file)
