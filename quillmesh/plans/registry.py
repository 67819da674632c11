"""The query registry and lazy access to the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting: deal the text tables to so many tasks on reading. Unset, scans stay as the files are laid
#: out; it is for files of one row group, which are one task whatever the cores.
READ_TASKS = "quillmesh.read.tasks"
TEXT_TABLES = {"documents", "pages", "conversations", "orders"}  # orders become SQL sources
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Input tables by name, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        tasks = self.spark.conf.get(READ_TASKS, None)
        df = df.repartition(int(tasks)) if tasks and name in TEXT_TABLES else df
        setattr(self, name, df)
        return df

    @property
    def files(self) -> DataFrame:
        from ..sources.files import document_files

        return document_files(self.documents)

    @property
    def html_files(self) -> DataFrame:
        return self.pages.select("page_id", F.col("url").alias("path"), F.col("html").alias("text"))

    def derived(self, kind: str) -> DataFrame:
        from . import derived

        return getattr(derived, kind)(self)


def query(name: str, sql: str | None = None):
    """Register a query and, if given, the SQL that must give the same rows."""
    def bind(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return bind


# SQL fragments shared by the checks.
FILES = "(SELECT doc_id, source || '/' || doc_id || '.txt' AS path, text, octet_length(encode(text)) AS size, lang, source FROM documents)"
LINES = f"(SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT path, string_split(text, chr(10)) AS l FROM {FILES}))"
