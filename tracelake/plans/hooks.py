"""Hooks that users compose: entry and message transforms, projectors, rules over recorded calls."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from tracelake.functions.scalars import utf16_length

Transform = Callable[[DataFrame], DataFrame]


def apply_transforms(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    """K1, K3: the transforms in order; each may replace the rows."""
    for t in transforms:
        df = df.transform(t)
    return df


class Projectors:
    """K2: what custom entries become, by their type: any number of messages each, in one pass over the entries for all types."""

    def __init__(self) -> None:
        self.by_type: dict[str, Callable[[str], Iterable[tuple[str, str]]]] = {}
        self.columns: dict[str, Column] = {}

    def register(self, custom_type: str, project: Callable[[str], Iterable[tuple[str, str]]]) -> None:
        """``project``: an entry's data to (role, text) pairs; a table function in Python."""
        self.by_type[custom_type] = project
        self.columns.pop(custom_type, None)

    def register_column(self, custom_type: str, messages: Column) -> None:
        """``messages``: an array of structs (role, text) over the entry's columns, which stays in the JVM."""
        self.columns[custom_type] = messages
        self.by_type.pop(custom_type, None)

    def project(self, entries: DataFrame, data: str = "data") -> DataFrame:
        """Messages (session_id, seq, part, role, text) of all registered types; ``part`` numbers those of an entry. Other types give none.

        The entries are read once. Columns make their messages in an expression; only rows of the other types go to the table function, in a
        lateral join. Null data gives none.
        """
        functions, none = dict(self.by_type), F.lit(None).cast("array<struct<role:string,text:string>>")

        class Made:
            def eval(self, custom_type: str, data: str, ready: list):
                made = ready if ready is not None else functions[custom_type](data) if custom_type in functions and data is not None else ()
                for part, (role, text) in enumerate(made):
                    yield part, role, text

        made = none
        for kind, column in self.columns.items():
            made = F.when(F.col("custom_type") == kind, column).otherwise(made)
        known = F.col("custom_type").isin(*self.by_type, *self.columns)
        rows = entries.filter((F.col("type") == "custom") & known).select("session_id", "seq", "custom_type", F.col(data).cast("string").alias("_data"), made.alias("_ready"))
        if not functions:
            out = rows.select("session_id", "seq", F.posexplode("_ready").alias("part", "m"))
            return out.select("session_id", "seq", "part", "m.role", "m.text")
        project = F.udtf(Made, returnType="part int, role string, text string")
        return rows.lateralJoin(project(F.col("custom_type").outer(), F.col("_data").outer(), F.col("_ready").outer())).select("session_id", "seq", "part", "role", "text")


def audit_calls(calls: DataFrame, rules: Sequence[tuple[str, Column, str, Column | None]]) -> DataFrame:
    """K4: recorded calls against rules (name, predicate, action, replacement arguments): adds ``rule``, ``action`` and ``arguments_after``.

    The first rule that holds counts. Actions: observe, block, rewrite.
    """
    name, action, after = F.lit(None).cast("string"), F.lit("allow"), F.col("arguments")
    for n, when, act, replacement in reversed(list(rules)):
        hit = F.coalesce(when, F.lit(False))
        name, action = F.when(hit, n).otherwise(name), F.when(hit, act).otherwise(action)
        after = F.when(hit, replacement if replacement is not None else F.col("arguments")).otherwise(after)
    return calls.withColumns({"rule": name, "action": action, "arguments_after": after})


def ordered_fold(df: DataFrame, by: str, order: Sequence[str], start: object, step: Callable[[object, dict], tuple[object, Iterable[dict]]], schema) -> DataFrame:
    """K6: a fold over each group's rows in order, for what no window can express: ``step(state, row)`` gives the next state and the rows to put out.

    A group is streamed from a sort that spills to disk; only its state is held. What is next depends on all before it, so one task takes
    a group, however long, but never holds it.
    """

    def run(batches):
        now, state = object(), start
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row[by] != now:
                    now, state = row[by], start
                state, made = step(state, row)
                out += made
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(schema)
    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def pack_transcripts(texts: DataFrame, most: int = 100_000, joiner: int = 2, by: str = "cwd", order: str = "seq", keep_text: bool = False) -> DataFrame:
    """Next-fit bins of texts in order, by directory: (cwd, seq, bin, size). A text longer than a bin has one of its own.

    Sizes are UTF-16 units: the column ``size`` if there is one, else the text's. The fold needs sizes only, so no text is in it; the texts are joined back if wanted.
    """
    sizes = texts.select(by, order, (F.col("size") if "size" in texts.columns else utf16_length("text")).cast("long").alias("size"))
    schema = T.StructType([*sizes.select(by, order).schema, T.StructField("bin", T.LongType()), T.StructField("size", T.LongType())])

    def step(state: tuple[int, int | None], row: dict) -> tuple[tuple, list[dict]]:
        number, used = state  # the bin's number, and what it holds; none where it takes no more
        size = row["size"]
        if used is None or used + joiner + size > most:
            number, used = number + 1, size
        else:
            used += joiner + size
        return (number, used if size <= most else None), [{by: row[by], order: row[order], "bin": number, "size": size}]

    packed = ordered_fold(sizes, by, [order], (-1, None), step, schema)
    return packed if not keep_text else packed.join(texts, [by, order])


#: Fixed value: what a line of a startup log's timing block looks like.
TIMING = r"^\s*(.+?):\s*(\d+(?:\.\d+)?)\s*ms\s*$"


def timing_summary(lines: DataFrame, begin: str = "--- Startup Timings ---", end: str = "------------------------") -> DataFrame:
    """Lowest, highest, mean and median milliseconds of each label in the marked blocks of logs. Rows: run, line_no, line."""
    w = W.partitionBy("run").orderBy("line_no")
    edge = F.when(F.trim("line") == begin, 1).when(F.trim("line") == end, 0)
    inside = F.coalesce(F.last(edge, ignorenulls=True).over(w), F.lit(0)) == 1
    rows = lines.withColumn("_in", inside).filter(F.col("_in") & F.col("line").rlike(TIMING)).select(F.trim(F.regexp_extract("line", TIMING, 1)).alias("label"), F.regexp_extract("line", TIMING, 2).cast("double").alias("ms"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"))
