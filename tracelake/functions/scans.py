"""Running aggregates over sessions of any length, by scans of two levels.

A session is cut into chunks of ``CHUNK`` sequence numbers. Windows run inside a chunk; each chunk gives one summary row; a scan over a
session's few summaries gives what each chunk carries in; and the two are combined. A session with a third of all rows is thus spread over
its chunks, and none of its windows holds more than one of them. Sessions of one chunk have nothing to carry and no summary row in the join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Sequence numbers in a chunk.
CHUNK = 1 << 17


@dataclass(frozen=True)
class Scan:
    """``op`` (sum, max, min, or last: the nearest value that isn't null) of ``value`` over the rows up to a row, or from it on if ``reverse``; the row itself counts if ``inclusive``."""

    op: str
    value: Column
    reverse: bool = False
    inclusive: bool = True

    def over(self, name: str, window) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[self.op](name).over(window)

    def summary(self, name: str, order: str) -> Column:
        if self.op == "last":
            there = F.when(F.col(name).isNotNull(), F.col(order))
            return (F.min_by if self.reverse else F.max_by)(name, there)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.op](name)

    def combined(self, own: Column, carried: Column) -> Column:
        if self.op == "sum":
            return F.coalesce(own + carried, own, carried, F.lit(0))
        return {"max": F.greatest, "min": F.least, "last": F.coalesce}[self.op](own, carried)


def scanned(rows: DataFrame, key: str = "session_id", order: str = "seq", **scans: Scan) -> DataFrame:
    """``rows`` with a column for each scan. ``order`` is a whole number, different for each row of a key, and not null. Null keys are one session."""
    rows = rows.withColumns({f"_v_{n}": s.value for n, s in scans.items()} | {"_chunk": F.floor(F.col(order) / CHUNK).cast("long")})

    def window(s: Scan, key: list[str], order: str, last: int):
        return W.partitionBy(*key).orderBy(F.desc(order) if s.reverse else F.asc(order)).rowsBetween(W.unboundedPreceding, last)

    chunks = rows.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_at")).agg(*(s.summary(f"_v_{n}", order).alias(f"_v_{n}") for n, s in scans.items()))
    chunks = chunks.withColumn("_chunks", F.count("*").over(W.partitionBy("_key"))).filter("_chunks > 1")
    carried = chunks.select("_key", "_at", *(s.over(f"_v_{n}", window(s, ["_key"], "_at", -1)).alias(f"_c_{n}") for n, s in scans.items()))
    own = {f"_o_{n}": s.over(f"_v_{n}", window(s, [key, "_chunk"], order, 0 if s.inclusive else -1)) for n, s in scans.items()}
    out = rows.withColumns(own).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")), "left")
    out = out.withColumns({n: s.combined(F.col(f"_o_{n}"), F.col(f"_c_{n}")) for n, s in scans.items()})
    return out.drop("_chunk", "_key", "_at", *(f"_{x}_{n}" for n in scans for x in "voc"))
