"""Shared helpers: tables, written intermediates, word arrays, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.storage import new_path, read_table, remove, shared_dir, written

__all__ = ["WORD_SEPARATOR", "components", "let", "new_path", "read_table", "release", "remove", "shared_dir", "words_of", "written", "written_clean"]

#: Words are runs of anything but ASCII white space.
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"

#: Where it is true, Spark deletes a query's shuffle files as the query ends, not when the driver has collected its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps now: they are deleted once the driver has collected those steps' plans."""
    gc.collect()
    spark._jvm.System.gc()


def written_clean(df: DataFrame, name: str) -> DataFrame:
    """``written``, with the shuffle files of this one step deleted as soon as it is done: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` refers to it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATOR), lambda w: w != "")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rounds; each round's edges are written, and their count and hash sum
    tell when nothing moves any more. A node without an edge has no row. Null ends and loops are left out.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that a hub's rows come to the join straight from their exchange, where Spark can split them
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lowest")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        step = written(small.distinct(), "edges")
        stamp = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        remove(now, low)
        now = step
        if stamp == seen:
            break
        seen = stamp
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
