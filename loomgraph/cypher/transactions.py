"""Statements in transactions. A graph version is never changed, so keeping one is all that a rollback needs."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomgraph.cypher.parser import QueryError
from loomgraph.cypher.write import execute
from loomgraph.graph import Graph

WORD = re.compile(r"\s*(BEGIN|COMMIT|ROLLBACK)(?:\s+TRANSACTION)?\s*;?\s*$", re.I)


class Transactions:
    """One client's statements on a graph.

    Outside of a transaction every statement counts at once. Inside, its changes are seen by the
    statements that follow and become the graph's at COMMIT; at ROLLBACK, or when a statement fails,
    the version of BEGIN is there again. Transactions aren't nested.
    """

    def __init__(self, graph: Graph, spark: SparkSession) -> None:
        self.graph, self.spark = graph, spark
        self.saved: Graph | None = None

    def execute(self, text: str, params: dict[str, Any] | None = None) -> DataFrame | None:
        """The rows that a statement returns, if it returns any."""
        m = WORD.match(text)
        if m:
            return getattr(self, m.group(1).lower())()
        now = replace(self.graph, indexes=dict(self.graph.indexes), constraints=dict(self.graph.constraints))
        try:
            done = execute(now, self.spark, text, params)
        except Exception:
            if self.saved is not None:
                self.rollback()
            raise
        # Procedures change the version they are called on, updates make a new one.
        self.graph = done.graph
        return done.rows

    def begin(self) -> None:
        if self.saved is not None:
            raise QueryError("a transaction is open already")
        self.saved = self.graph

    def commit(self) -> None:
        if self.saved is None:
            raise QueryError("no transaction is open")
        self.saved = None

    def rollback(self) -> None:
        if self.saved is None:
            raise QueryError("no transaction is open")
        self.graph, self.saved = self.saved, None
