"""Named queries over the derived knowledge base."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Base:
    """The tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in views.VIEWS:
            raise AttributeError(name)
        return views.view(self.spark, self.sf_dir, name)

    @cached_property
    def rules(self) -> DataFrame:
        """Rules with their page references as an array."""
        ref = F.struct(F.concat(F.lit("Book "), F.element_at(F.split("collection_id", ":"), 2)).alias("source_name"), F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))
        return self.rule.withColumn("page_refs", F.array(ref)).drop("page_start", "page_end")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Base; sql is its check over the same views."""

    def add(f: Callable[[Base], DataFrame]) -> Callable[[Base], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if sql:
            SQL[name] = views.with_views(sql)
        return f

    return add


def sql_key(x: str) -> str:
    """The key of a name, for a check."""
    folded = rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    clean = rf"regexp_replace({folded}, '[''’]s( |$)', '\1', 'g')"
    words = rf"string_split(trim(regexp_replace(regexp_replace({clean}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    one = "CASE WHEN s IN ('series', 'species') OR strlen(s) <= 3 THEN s WHEN s LIKE '%ies' THEN left(s, length(s) - 3) || 'y' WHEN s LIKE '%es' AND s NOT LIKE '%ses' THEN left(s, length(s) - 2) WHEN s LIKE '%s' AND NOT regexp_matches(s, '(ss|us|os|as|is)$') THEN left(s, length(s) - 1) ELSE s END"
    return f"list_transform([{words}], lambda w: list_aggregate(list_transform(CASE WHEN w[1] = 'the' AND len(w) > 1 THEN w[2:] ELSE w END, lambda s: {one}), 'string_agg', ' '))[1]"


#: Rows that aren't marked as deleted, in a check.
LIVE = "vault_deleted IS DISTINCT FROM true"
STALE = "(codex_stale IS DISTINCT FROM false OR codex_article IS NULL)"
