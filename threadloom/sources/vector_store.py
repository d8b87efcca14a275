"""A persisted store of vectors that answers neighbour queries exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadloom.operators.edges import neighbors_of
from threadloom.operators.merge import SnapshotStore


class ExactStore:
    """``VectorStore`` over versions of one table ``(scope, id, vec)``; a query sees the version that it began with."""

    def __init__(self, store: SnapshotStore, name: str = "vector_index") -> None:
        self.store, self.name = store, name

    def upsert(self, rows: DataFrame) -> None:
        self.store.merge(self.name, rows.select("scope", "id", "vec"), ["scope", "id"])

    def remove(self, ids: DataFrame) -> None:
        """Drop the vectors of ``(scope, id)``."""
        self.store.write(self.name, self.store.read(self.name).join(ids.select("scope", "id"), ["scope", "id"], "left_anti"))

    def query(self, queries: DataFrame, k: int, floor: float) -> DataFrame:
        """``(scope, left_id, right_id, score, rank)`` of ``queries`` ``(scope, id, vec)``."""
        return neighbors_of(queries, self.store.read(self.name), k, floor)
