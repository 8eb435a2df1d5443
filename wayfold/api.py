"""The Python API: a store of tables with SQL, search and tree look-ups."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import preview
from .operators import trees, vectors

# The tables of the test data.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def reads_only(spark: SparkSession, statement: str) -> bool:
    """Whether the parsed statement holds no command and no insert, in any part of it."""
    command = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    while todo:
        node = todo.pop()
        if command.isInstance(node) or node.getClass().getSimpleName().startswith("Insert"):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


class Store:
    """Parquet tables in one folder, as temporary views, behind a read-only SQL interface."""

    def __init__(self, spark: SparkSession, folder: str, names: Sequence[str] = TABLES):
        self.spark, self.folder, self.names = spark, folder, list(names)

    def table(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, statement: str, args: Mapping | Sequence | None = None) -> DataFrame:
        """Run one SELECT with named (:name) or positional (?) parameters.

        Values travel as parameters, never as text. Statements that could change anything
        are refused. Only the tables that the statement names are opened.
        """
        if not reads_only(self.spark, statement):
            raise PermissionError("only queries are allowed")
        for n in self.names:
            if re.search(rf"\b{n}\b", statement, re.I):
                self.table(n).createOrReplaceTempView(n)
        return self.spark.sql(statement, args=args if args is None or isinstance(args, Mapping) else list(args))

    def first(self, statement: str, args: Mapping | Sequence | None = None):
        """The first row or None."""
        return self.sql(statement, args).head()


def semantic_search(rows: DataFrame, query: Sequence[float], limit: int = 10, filters: Mapping | None = None) -> DataFrame:
    """id, url, title, score and preview of the nearest pages; the score is a distance, lower is closer."""
    hits = vectors.search(rows, query, limit, filters)
    return hits.select(F.col("key").alias("id"), "url", "title", F.col("_distance").alias("score"), preview(F.col("page_content"), 200).alias("preview"))


def webpage_content(rows: DataFrame, page_session_id: object) -> DataFrame:
    """The stored content of one page."""
    return vectors.get(rows, page_session_id)


def recent_trees(members: DataFrame, excluded: str | None = None, limit: int = 5) -> DataFrame:
    """Members of the most recently active trees."""
    return trees.recent(members, excluded, limit)
