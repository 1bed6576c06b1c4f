"""Entry trees. Grain of ``entries``: one row an entry, key (session_id, seq); ``parent_seq`` points to another row or is null.

``leaf`` and the like are DataFrames with one row a session (session_id, seq). Every operator runs for all sessions at once.
Paths are found by pointer doubling: log2(depth) joins on (session, entry), so deep chains and large sessions spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from tracelake.functions.scans import Scan, scanned
from tracelake.functions.storage import joins_by_rows, written



def by_session() -> WindowSpec:
    return W.partitionBy("session_id")


def in_order() -> WindowSpec:
    return by_session().orderBy("seq")


def last_entry(entries: DataFrame) -> DataFrame:
    """The default leaf: each session's last entry."""
    return entries.groupBy("session_id").agg(F.max("seq").alias("seq"))


def migrate_v1_to_v2(entries: DataFrame) -> DataFrame:
    """B1: a linear log as a tree: stable ids, parent = previous row, kept index (which counts the header) as an entry id."""
    new_id = lambda seq: F.substring(F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), seq.cast("string")), 256), 1, 8)
    out = entries.withColumn("entry_id", new_id(F.col("seq"))).withColumn("parent_id", F.lag(new_id(F.col("seq"))).over(in_order()))
    if "first_kept_index" in entries.columns:
        place = F.row_number().over(in_order())
        places = out.select("session_id", place.alias("first_kept_index"), F.col("entry_id").alias("first_kept_entry_id"))
        out = out.join(places, ["session_id", "first_kept_index"], "left").drop("first_kept_index")
    return out


def migrate_v2_to_v3(entries: DataFrame) -> DataFrame:
    """B2: role hookMessage becomes custom, version 3; rows of version 3 stay as they are."""
    old = F.col("version") < 3
    return entries.withColumn("role", F.when(old & (F.col("role") == "hookMessage"), "custom").otherwise(F.col("role"))).withColumn("version", F.greatest("version", F.lit(3)))


def filter_entries(entries: DataFrame, mode: str = "default", leaf: DataFrame | None = None) -> DataFrame:
    """Rows a mode shows. Columns used: type, role, and if there: has_text, stop_reason, label."""
    role = F.coalesce(F.col("role"), F.lit("")) if "role" in entries.columns else F.lit("")
    hidden = F.col("type").isin("label", "custom", "model_change", "thinking_level_change", "session_info")
    keep = {
        "default": ~hidden,
        "no-tools": ~hidden & ~((F.col("type") == "message") & (role == "toolResult")),
        "user-only": (F.col("type") == "message") & (role == "user"),
        "labeled-only": F.col("label").isNotNull() if "label" in entries.columns else F.lit(False),
        "all": F.lit(True),
    }[mode]
    if "has_text" in entries.columns:
        usual = F.coalesce(F.col("stop_reason"), F.lit("stop")).isin("stop", "toolUse") if "stop_reason" in entries.columns else F.lit(True)
        silent = (F.col("type") == "message") & (role == "assistant") & ~F.col("has_text") & usual
        if leaf is not None:
            entries = entries.join(leaf.select("session_id", F.col("seq").alias("_leaf")), "session_id", "left")
            keep = keep & (~silent | F.col("seq").eqNullSafe(F.col("_leaf")))
            return entries.filter(keep).drop("_leaf")
        keep = keep & ~silent
    return entries.filter(keep)


def search_entries(entries: DataFrame, query: str, text: Column | str = "text") -> DataFrame:
    """All white-space separated tokens of the query occur in a row's text, in any case."""
    t, keep = F.lower(F.col(text) if isinstance(text, str) else text), F.lit(True)
    for token in query.lower().split():
        keep = keep & t.contains(token)
    return entries.filter(keep)


def entries_of_type(entries: DataFrame, kind: str) -> DataFrame:
    """Rows of a type in sequence order."""
    return entries.filter(F.col("type") == kind).orderBy("session_id", "seq")


def ancestors(entries: DataFrame, start: DataFrame) -> DataFrame:
    """(…start's keys…, seq, distance): every entry on the paths from ``start`` (session_id, seq, and any further keys) to the roots.

    After round k the paths hold all entries at a distance below 2 ** k. A cycle ends when nothing new is met.
    """
    keys = [c for c in start.columns if c != "seq"]
    jump = entries.select("session_id", "seq", F.col("parent_seq").alias("up")).filter("up IS NOT NULL AND up != seq")
    known = entries.select("session_id", F.col("seq").alias("up"))
    jump = jump.join(known, ["session_id", "up"], "left_semi").select("session_id", "seq", "up")
    paths = start.join(entries.select("session_id", "seq"), ["session_id", "seq"], "left_semi").select(*keys, "seq", F.lit(0).cast("long").alias("distance"))
    step = 1
    with joins_by_rows(entries.sparkSession):
        while True:
            more = paths.join(jump, ["session_id", "seq"]).select(*keys, F.col("up").alias("seq"), (F.col("distance") + step).alias("distance"))
            more = written(more.join(paths, [*keys, "seq"], "left_anti"), "path")
            if more.isEmpty():
                return paths
            paths = written(paths.unionByName(more), "paths")
            above = jump.select("session_id", F.col("seq").alias("up"), F.col("up").alias("up2"))
            jump = written(jump.join(above, ["session_id", "up"]).select("session_id", "seq", F.col("up2").alias("up")), "jumps")
            step *= 2


def walk_paths(entries: DataFrame, leaf: DataFrame) -> DataFrame:
    """The same for one leaf a session, as a pointer walk over each session in memory: for many sessions of moderate size."""

    def run(table: pa.Table) -> pa.Table:
        up = dict(zip(table["seq"].to_pylist(), table["parent_seq"].to_pylist(), strict=True))
        at, out = table["leaf"][0].as_py(), []
        while at in up and at not in out[-1:] and len(out) <= len(up):
            out.append(at)
            at = up[at]
        return pa.table({"session_id": pa.array([table["session_id"][0].as_py()] * len(out), table["session_id"].type), "seq": pa.array(out, table["seq"].type), "distance": pa.array(range(len(out)), pa.int64())})

    rows = entries.select("session_id", "seq", "parent_seq").join(leaf.select("session_id", F.col("seq").alias("leaf")), "session_id")
    return rows.groupBy("session_id").applyInArrow(run, entries.select("session_id", "seq").schema.add("distance", "long"))


def branch_path(entries: DataFrame, leaf: DataFrame | None = None, strategy: str = "doubling") -> DataFrame:
    """Root-to-leaf path with ``pos`` from 0 at the root; a parent that doesn't exist ends it; no leaf, no path."""
    leaf = (last_entry(entries) if leaf is None else leaf).filter("seq IS NOT NULL")
    found = ancestors(entries, leaf.select("session_id", "seq")) if strategy == "doubling" else walk_paths(entries, leaf)
    depth = found.groupBy("session_id").agg(F.max("distance").alias("_d"))
    return found.join(depth, "session_id").select("session_id", "seq", (F.col("_d") - F.col("distance")).alias("pos"))


def on_path(entries: DataFrame, path: DataFrame) -> DataFrame:
    """Path rows with the entries' columns."""
    return path.join(entries, ["session_id", "seq"])


def path_to_root_or_compaction(entries: DataFrame, leaf: DataFrame | None = None) -> DataFrame:
    """The path down from the nearest compaction that carries a tail, that row included; without one, from the kept row of the
    nearest compaction if it is on the path, else from that compaction; without any, the whole path. A missing parent fails the job.

    Columns used if there: has_tail, first_kept_seq.
    """
    has = set(entries.columns)
    ends = entries.filter("parent_seq IS NOT NULL").join(entries.select("session_id", F.col("seq").alias("parent_seq")), ["session_id", "parent_seq"], "left_anti")
    path = on_path(entries, branch_path(entries, leaf)).join(ends.select("session_id", "seq", F.lit(True).alias("_lost")), ["session_id", "seq"], "left")
    path = path.withColumn("pos", F.when(F.col("_lost"), F.raise_error(F.lit("an entry's parent is missing")).cast("long")).otherwise(F.col("pos"))).drop("_lost")
    compaction = F.col("type") == "compaction"
    tail = compaction & (F.coalesce(F.col("has_tail"), F.lit(False)) if "has_tail" in has else F.lit(False))
    kept = F.col("first_kept_seq") if "first_kept_seq" in has else F.lit(None).cast("long")
    marks = path.groupBy("session_id").agg(F.max(F.when(tail, F.col("pos"))).alias("_tail"), F.max_by(F.struct(F.col("pos"), kept.alias("kept")), F.when(compaction, F.col("pos"))).alias("_c"))
    kept_pos = path.join(marks.select("session_id", F.col("_c.kept").alias("seq")), ["session_id", "seq"]).select("session_id", F.col("pos").alias("_kept"))
    start = marks.join(kept_pos, "session_id", "left").select("session_id", F.coalesce(F.when(F.col("_tail") == F.col("_c.pos"), F.col("_tail")), "_kept", "_c.pos", F.lit(0)).alias("_start"))
    return path.join(start, "session_id").filter("pos >= _start").drop("_start")


def common_ancestor(entries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The deepest entry on both root paths."""
    pa_, pb = branch_path(entries, a), branch_path(entries, b)
    return pa_.join(pb.select("session_id", "seq"), ["session_id", "seq"]).groupBy("session_id").agg(F.max_by("seq", "pos").alias("seq"))


def resolve_labels(entries: DataFrame, labels: DataFrame, trim: bool = False) -> DataFrame:
    """Entries with the last label given to them and its time; an empty label clears. ``labels``: session_id, seq, target, label, ts."""
    text = F.trim("label") if trim else F.col("label")
    last = labels.groupBy("session_id", F.col("target").alias("seq")).agg(F.max_by(F.struct(text.alias("label"), F.col("ts").alias("label_ts")), "seq").alias("l"))
    last = last.select("session_id", "seq", "l.*").filter("label IS NOT NULL AND label != ''")
    return entries.join(last, ["session_id", "seq"], "left")


def nearest(entries: DataFrame, stop: Column) -> DataFrame:
    """(session_id, seq, near): the nearest proper ancestor that ``stop`` holds for; null without one, and on a cycle without one.

    Pointers double until they meet such a row or a root: one row an entry in each of log2(depth) rounds.
    """
    known = entries.select("session_id", F.col("seq").alias("up"), F.coalesce(stop, F.lit(False)).alias("_stop"))
    rows = entries.select("session_id", "seq", F.when(F.col("parent_seq") != F.col("seq"), F.col("parent_seq")).alias("up")).join(known, ["session_id", "up"], "left")
    up = F.when(F.col("_stop").isNotNull(), F.col("up"))
    now = written(rows.select("session_id", "seq", up.alias("up"), (up.isNull() | F.col("_stop")).alias("done")), "nearest")
    most, step = now.count(), 1
    while step < 2 * most and not now.filter("NOT done").isEmpty():
        above = now.select("session_id", F.col("seq").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"))
        moved = now.filter("NOT done").join(above, ["session_id", "up"]).select("session_id", "seq", F.col("up2").alias("up"), F.col("done2").alias("done"))
        now, step = written(now.filter("done").unionByName(moved), "nearest"), 2 * step
    return now.select("session_id", "seq", F.when(F.col("done"), F.col("up")).alias("near"))


def session_lineage(sessions: DataFrame) -> DataFrame:
    """Root, depth and latest activity over the subtree of each session, and its place in the listing. Rows: session_id, parent_id, ts; a missing parent is a root.

    ``position`` (from 0) is the place in the tree walked from the top, siblings and roots by latest activity, newest first (ties: by id);
    ``is_last``: no sibling follows; ``size``: sessions in the subtree. Sessions on a cycle and below one have no position.

    List ranking by doubling. Pointers double, and in round k each session hands what lies less than 2 ** k below it to the one 2 ** k above. Then a
    session stands one behind its parent and all that its earlier siblings hold, a running sum by a two-level scan (so roots, and
    the children of one parent, may be most of the table), and these offsets are added up along the pointers again.
    """
    known = sessions.select(F.col("session_id").alias("up")).withColumn("_known", F.lit(True))
    rows = sessions.select("session_id", F.when(F.col("parent_id") != F.col("session_id"), F.col("parent_id")).alias("up"), "ts").join(known, "up", "left")
    up = F.when(F.col("_known"), F.col("up"))
    now = written(rows.select("session_id", up.alias("up"), up.alias("parent"), F.coalesce(up, F.col("session_id")).alias("root"), up.isNotNull().cast("long").alias("depth"), F.col("ts").alias("latest"), F.lit(1).cast("long").alias("size")), "lineage")
    most, step = now.count(), 1
    while step < 2 * most and not now.filter("up IS NOT NULL").isEmpty():
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("session_id")).agg(F.max("latest").alias("_latest"), F.sum("size").alias("_size"))
        above = now.select(F.col("session_id").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        moved = now.join(above, "up", "left").join(below, "session_id", "left")
        moved = moved.select("session_id", F.col("up2").alias("up"), "parent", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.greatest("latest", "_latest").alias("latest"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"))
        now, step = written(moved, "lineage"), 2 * step
    sorted_ = now.repartitionByRange("parent", F.desc("latest"), "session_id").sortWithinPartitions("parent", F.desc("latest"), "session_id")
    sorted_ = written(sorted_.withColumn("at", F.monotonically_increasing_id()), "lineage-sorted")
    ranked = scanned(sorted_, key="parent", order="at", before=Scan("sum", F.col("size"), inclusive=False), later=Scan("last", F.lit(1), reverse=True, inclusive=False))
    ranked = ranked.withColumn("before", F.coalesce("before", F.lit(0)))
    walk = written(ranked.select("session_id", F.col("parent").alias("up"), (F.col("before") + F.col("parent").isNotNull().cast("long")).alias("position"), F.col("later").isNull().alias("is_last")), "lineage-walk")
    step = 1
    while step < 2 * most and not walk.filter("up IS NOT NULL").isEmpty():
        above = walk.select(F.col("session_id").alias("up"), F.col("up").alias("up2"), F.col("position").alias("more"))
        moved = walk.join(above, "up", "left").select("session_id", F.col("up2").alias("up"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"), "is_last")
        walk, step = written(moved, "lineage-walk"), 2 * step
    place = walk.select("session_id", F.when(F.col("up").isNull(), F.col("position")).alias("position"), "is_last")
    return now.select("session_id", "root", "depth", "latest", "size").join(place, "session_id")


def children(entries: DataFrame) -> DataFrame:
    """Adjacency in order of time: (session_id, parent_seq, children). Roots (no, own or missing parent) stand under null."""
    known = entries.select("session_id", F.col("seq").alias("parent_seq"), F.lit(True).alias("_known"))
    rows = entries.join(known, ["session_id", "parent_seq"], "left")
    parent = F.when(F.col("_known") & (F.col("parent_seq") != F.col("seq")), F.col("parent_seq"))
    out = rows.groupBy("session_id", parent.alias("parent_seq")).agg(F.sort_array(F.collect_list(F.struct("ts", "seq"))).alias("c"))
    return out.select("session_id", "parent_seq", F.transform("c", lambda x: x["seq"]).alias("children"))


def entry_slice_per_session(entries: DataFrame, offset: int, n: int) -> DataFrame:
    """for every session, n rows from an offset in sequence order."""
    return entries.withColumn("_n", F.row_number().over(in_order())).filter((F.col("_n") > offset) & (F.col("_n") <= offset + n)).drop("_n")


def last_n_per_session(entries: DataFrame, n: int, before_seq: int | None = None) -> DataFrame:
    """for every session, the newest n rows at or below a sequence, ascending."""
    rows = entries if before_seq is None else entries.filter(F.col("seq") <= before_seq)
    return rows.withColumn("_n", F.row_number().over(by_session().orderBy(F.desc("seq")))).filter(F.col("_n") <= n).drop("_n").orderBy("session_id", "seq")


def latest_custom_state(entries: DataFrame, kinds: Sequence[str], data: str, leaf: DataFrame | None = None) -> DataFrame:
    """the last row of each wanted type on the branch: (session_id, type, seq, data)."""
    rows = on_path(entries, branch_path(entries, leaf)).filter(F.col("type").isin(*kinds))
    return rows.groupBy("session_id", "type").agg(F.max("seq").alias("seq"), F.max_by(data, "seq").alias("data"))


def context_entries(entries: DataFrame, leaf: DataFrame | None = None, harness: bool = False) -> DataFrame:
    """What a model sees of a path: the latest compaction first, then its kept rows, then the rows after it.

    Kept rows run from ``first_kept_seq`` to before the compaction; the harness form has the stored tail instead and keeps none.
    ``context_pos`` is the order.
    """
    path = on_path(entries, branch_path(entries, leaf))
    kept = F.col("first_kept_seq") if "first_kept_seq" in entries.columns else F.lit(None).cast("long")
    last = path.groupBy("session_id").agg(F.max_by(F.struct("pos", kept.alias("kept")), F.when(F.col("type") == "compaction", F.col("pos"))).alias("_c"))
    at = path.join(last.select("session_id", F.col("_c.kept").alias("seq")), ["session_id", "seq"]).select("session_id", F.col("pos").alias("_from"))
    rows = path.join(last.select("session_id", F.col("_c.pos").alias("_at")), "session_id").join(at, "session_id", "left")
    before = F.lit(False) if harness else (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_at"))
    keep = F.col("_at").isNull() | (F.col("pos") >= F.col("_at")) | F.coalesce(before, F.lit(False))
    order = F.struct(F.when(F.col("pos") == F.col("_at"), 0).otherwise(1), F.col("pos"))
    return rows.filter(keep).withColumn("context_pos", F.row_number().over(by_session().orderBy(order)) - 1).drop("_at", "_from")


def session_context(entries: DataFrame, leaf: DataFrame | None = None, state: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Context rows, and per session the last values of ``state`` columns on the full path (level: default off)."""
    path = on_path(entries, branch_path(entries, leaf))
    last = path.groupBy("session_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in state), F.count("*").alias("path_rows"))
    if "thinking_level" in state:
        last = last.withColumn("thinking_level", F.coalesce("thinking_level", F.lit("off")))
    return context_entries(entries, leaf), last


def contract_tree(entries: DataFrame, visible: Column) -> DataFrame:
    """Visible rows, each under its nearest visible ancestor (null: none)."""
    near = nearest(entries, visible).withColumnRenamed("near", "visible_parent")
    return entries.filter(visible).select("session_id", "seq").join(near, ["session_id", "seq"])


def fold_descendants(entries: DataFrame, folded: DataFrame) -> DataFrame:
    """Entries without the descendants of folded rows (session_id, seq)."""
    marked = entries.join(folded.select("session_id", "seq").distinct().withColumn("_folded", F.lit(True)), ["session_id", "seq"], "left")
    under = nearest(marked, F.col("_folded")).filter("near IS NOT NULL")
    return entries.join(under, ["session_id", "seq"], "left_anti")


def active_path_flags(entries: DataFrame, leaf: DataFrame | None = None) -> DataFrame:
    """Entries with ``on_path`` and ``is_branch_point`` (two children or more)."""
    path = branch_path(entries, leaf).select("session_id", "seq", F.lit(True).alias("on_path"))
    forks = entries.filter("parent_seq IS NOT NULL").groupBy("session_id", F.col("parent_seq").alias("seq")).agg((F.count("*") > 1).alias("is_branch_point"))
    out = entries.join(path, ["session_id", "seq"], "left").join(forks, ["session_id", "seq"], "left")
    return out.withColumn("on_path", F.coalesce("on_path", F.lit(False))).withColumn("is_branch_point", F.coalesce("is_branch_point", F.lit(False)))


def abandoned_entries(entries: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """H1: rows of the old path that aren't on the new one, with their place, in order."""
    return branch_path(entries, old).join(branch_path(entries, new).select("session_id", "seq"), ["session_id", "seq"], "left_anti").orderBy("session_id", "pos")


def fork_session(entries: DataFrame, at: DataFrame | None = None, position: str = "at", suffix: str = "-fork") -> tuple[DataFrame, DataFrame]:
    """H4: (headers, entries) of forks that copy the path to an entry; ``before`` copies to its parent, and it must be a user row.

    Without an entry, all rows are copied. The new header links to the parent session.
    """
    name = F.concat(F.col("session_id").cast("string"), F.lit(suffix))
    if at is None:
        rows = entries
    else:
        leaf = at.select("session_id", "seq")
        if position == "before":
            ok = F.when(F.coalesce(F.col("role"), F.lit("")) == "user", F.col("parent_seq")).otherwise(F.raise_error(F.lit("only a user entry can be forked before")).cast("long"))
            # written first: else the check would be pushed below the join, to all entries
            points = written(leaf.join(entries, ["session_id", "seq"]).select("session_id", "role", "parent_seq"), "fork-points")
            leaf = points.select("session_id", ok.alias("seq"))
        rows = on_path(entries, branch_path(entries, leaf)).drop("pos")
    sources = entries.select("session_id").distinct() if at is None else at.select("session_id").distinct()
    return sources.select(name.alias("session_id"), F.col("session_id").alias("parent_session")), rows.withColumn("session_id", name)


def extract_branch(entries: DataFrame, leaf: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """H5: the path without label rows, parents chained anew, and the surviving labels of its rows at the end."""
    path = on_path(entries, branch_path(entries, leaf)).filter("type != 'label'")
    rows = path.select("session_id", "seq", "type", F.lag("seq").over(by_session().orderBy("pos")).alias("parent_seq"), (F.row_number().over(by_session().orderBy("pos")) - 1).cast("long").alias("pos"))
    if labels is None:
        return rows
    kept = resolve_labels(rows.select("session_id", "seq", "pos"), labels).filter("label IS NOT NULL")
    ends = rows.groupBy("session_id").agg(F.max("pos").alias("_n"), F.max("seq").alias("_last"))
    tail = kept.join(ends, "session_id").withColumn("_k", F.row_number().over(by_session().orderBy("pos")))
    tail = tail.select("session_id", (F.col("_last") + F.col("_k")).alias("seq"), F.lit("label").alias("type"), (F.col("_last") + F.col("_k") - 1).alias("parent_seq"), (F.col("_n") + F.col("_k")).alias("pos"), F.col("seq").alias("target"), "label")
    return rows.unionByName(tail, allowMissingColumns=True)
