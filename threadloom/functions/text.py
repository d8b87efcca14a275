"""Text functions as Column builders; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.config import CHARS_PER_TOKEN, ITEM_TOKENS, SNIPPET_CHARS, TRUNCATION_MARKER

#: Fixed value: the characters that count as white space.
SPACE_CODES = (0x20, *range(0x09, 0x0E), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACE = "[" + "".join(map(chr, SPACE_CODES)) + "]"


def squash(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+$", "")


def filled(text: Column) -> Column:
    """Null for an empty text, so that concatenations skip it."""
    return F.when(text != "", text)


def is_bot(login: Column, kind: Column, flag: Column) -> Column:
    """Flagged, typed, or named like a bot."""
    name = F.lower(F.coalesce(login, F.lit("")))
    return (F.coalesce(flag, F.lit(0)) == 1) | (F.lower(F.coalesce(kind, F.lit(""))) == "bot") | name.endswith("[bot]") | name.contains("renovate") | name.contains("dependabot")


def names_of(json: Column, field: str) -> Column:
    """Strings of a JSON array of strings or of objects with ``field``; empty and invalid entries are left out."""
    raw = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    named = F.transform(raw, lambda x: F.when(x.startswith("{"), F.get_json_object(x, f"$.{field}")).otherwise(x))
    return F.filter(named, lambda x: x.isNotNull() & (x != ""))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def truncated(text: Column, tokens: int = ITEM_TOKENS) -> Column:
    """Cut to the length that an item may have, with a marker; shorter texts stay."""
    most = tokens * CHARS_PER_TOKEN
    cut = F.concat(right_trim(F.substring(text, 1, max(0, most - len(TRUNCATION_MARKER)))), F.lit(TRUNCATION_MARKER))
    return F.when(F.length(text) > most, cut).otherwise(text)


def snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    """Collapsed text of at most ``most`` characters, cut ones ending in an ellipsis; null where nothing is left."""
    flat = squash(text)
    return filled(F.when(F.length(flat) <= most, flat).otherwise(F.concat(right_trim(F.substring(flat, 1, most - 1)), F.lit("…"))))


def tokens_of(*texts: Column) -> Column:
    """Lower-cased words, the runs of letters and digits, of the texts together."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return F.array_remove(F.split(joined, r"[^\p{L}\p{N}]+"), "")
