"""Vector functions as Column builders, for single vectors; many-to-many similarity goes through the blocked operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different lengths raise an error, null vectors give null."""
    same = F.size(a) == F.size(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(same, total).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays. The length is taken once, not for each element."""
    size = norm(a)
    return F.zip_with(a, F.array_repeat(F.when(size == 0, F.lit(1.0)).otherwise(size), F.size(a)), lambda x, s: x.cast("double") / s)


def score_of_distance(distance: Column) -> Column:
    """The cosine of two vectors of length 1 from their squared distance."""
    return 1 - distance / 2


#: Fixed values of the query sizes.
LARGE, WIDEN, LEAST_WIDE, PER_ROW, LEAST_CANDIDATES, LEAST_EF = 5000, 4, 24, 16, 512, 1024


def query_size(n: int, k: int) -> dict[str, int]:
    """How many rows a neighbour query over ``n`` vectors asks for, and how many candidates it looks at."""
    if n < LARGE:
        candidates = max(PER_ROW * k, 64)
        return {"limit": k, "candidates": candidates, "ef": max(2 * candidates, LEAST_EF)}
    limit = min(max(WIDEN * k, LEAST_WIDE), n - 1)
    candidates = min(max(PER_ROW * limit, LEAST_CANDIDATES), max(limit, n - 1))
    return {"limit": limit, "candidates": candidates, "ef": max(2 * candidates, LEAST_EF)}


def usable(json: Column, dimensions: Column) -> Column:
    """The vector of a JSON array of exactly ``dimensions`` finite numbers that are not all zero; null otherwise."""
    text = F.trim(F.translate(json, "\t\n\r", "   "))
    whole = text.startswith("[") & (F.instr(text, "]") == F.length(text))
    vec = F.from_json(F.when(whole, json), "array<double>")
    good = (F.size(vec) == dimensions) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return F.when(good, vec)
