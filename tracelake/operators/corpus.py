"""Text corpora and session listings: lines, search, slices, edits. Corpus grain: one row a document, key doc_id."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracelake.functions.scalars import LONG_LINE, normalise_text, truncate_line

#: Limits of a reading.
MAX_LINES = 2000
MAX_BYTES = 51_200
MATCHES = 100
PATHS = 1000


def read_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Numbered lines (from 0); CRLF and CR count as line feeds."""
    return docs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("pos", "line"))


def glob_pattern(glob: str) -> str:
    """A path glob as a pattern: ** crosses folders, * and ? don't, [..] and {a,b} are sets."""
    out, depth, k = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and (end := glob.find("]", k + 1)) > 0:
            out, k = out + glob[k : end + 1].replace("[!", "[^"), end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        k += 1
    return f"^{out}$" if "/" in glob else f"^(?:.*/)?{out}$"


def find_paths(corpus: DataFrame, glob: str, limit: int | None = PATHS, path: str = "path") -> DataFrame:
    """Paths that match a glob, in order, at most ``limit``."""
    out = corpus.filter(F.col(path).rlike(glob_pattern(glob))).select(path).orderBy(path)
    return out if limit is None else out.limit(limit)


def named_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with a name that isn't blank."""
    return sessions.filter(F.trim(F.coalesce("name", F.lit(""))) != "")


def feeds(text: str) -> Column:
    """A text with line feeds only."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def grep_corpus(docs: DataFrame, pattern: str, context: int = 0, limit: int | None = MATCHES, ignore_case: bool = False, literal: bool = False, key: str = "doc_id") -> DataFrame:
    """Matching lines with ``context`` lines around, long ones cut: key, pos, line, is_match. ``limit`` caps the matches.

    Documents without a match are dropped first; the others' lines are matched inside their row, and only those to show are dealt
    out, so nothing is shuffled. A limit takes a top-k of (key, pos) first: rows of equal key then share what it allows them.
    """
    test = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else pattern
    case = "(?i)" if ignore_case else ""
    rows = docs.filter(feeds("text").rlike(("(?im)" if ignore_case else "(?m)") + test)).select(key, F.split(feeds("text"), "\n").alias("_lines"))
    hits = F.filter(F.transform("_lines", lambda x, k: F.when(x.rlike(case + test), k)), lambda k: k.isNotNull())
    rows = rows.withColumn("_hits", hits)
    if limit is not None:
        top = rows.select(key, F.explode("_hits").alias("pos")).orderBy(key, "pos").limit(limit)
        top = top.groupBy(key).agg(F.collect_set("pos").alias("_top"))  # at most ``limit`` rows, so small enough to broadcast
        rows = rows.join(F.broadcast(top), key).withColumn("_hits", F.array_intersect("_hits", "_top"))
    around = F.array_distinct(F.flatten(F.transform("_hits", lambda k: F.sequence(F.greatest(k - context, F.lit(0)), F.least(k + context, F.size("_lines") - 1)))))
    shown = rows.select(key, "_lines", "_hits", F.explode(F.array_sort(around)).alias("pos"))
    return shown.select(key, "pos", truncate_line(F.element_at("_lines", F.col("pos") + 1), LONG_LINE).alias("line"), F.array_contains("_hits", F.col("pos")).alias("is_match"))


def fitting(lines: Column, max_lines: int, max_bytes: int) -> Column:
    """How many of the first lines fit into both limits, and their bytes, line feeds between them included: struct n, bytes."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("bytes"), F.lit(True).alias("open"))

    def take(now: Column, line: Column) -> Column:
        size = now["bytes"] + F.octet_length(line) + 1
        fits = now["open"] & (size <= max_bytes)
        return F.struct(F.when(fits, now["n"] + 1).otherwise(now["n"]).alias("n"), F.when(fits, size).otherwise(now["bytes"]).alias("bytes"), fits.alias("open"))

    return F.aggregate(F.slice(lines, 1, max_lines), start, take, lambda x: F.struct(x["n"].alias("n"), F.greatest(x["bytes"], F.lit(0)).cast("long").alias("bytes")))


def end_of_line(line: Column, max_bytes: int) -> Column:
    """The end of a line of at most so many bytes, from where a character starts."""
    tail = F.substring(F.encode(line, "UTF-8"), -max_bytes, max_bytes)
    inside = lambda k: F.hex(F.substring(tail, k, 1)).rlike("^[89AB]")  # noqa: E731  a byte inside a character
    skip = F.when(~inside(1), 0).when(~inside(2), 1).when(~inside(3), 2).otherwise(3)
    cut = F.decode(F.substring(tail, skip + 1, F.lit(max_bytes)), "UTF-8")
    return F.when(F.octet_length(line) <= max_bytes, line).otherwise(cut)


def truncated(rows: DataFrame, max_lines: int, max_bytes: int, side: str) -> DataFrame:
    """Adds G10's account of the array ``_lines``."""
    # at the end of a text, a line feed ends the last line and begins no further one
    if side == "tail":
        last = F.element_at("_lines", -1)
        rows = rows.withColumn("_all", F.when((F.size("_lines") > 1) & (last == ""), F.slice("_lines", F.lit(1), F.size("_lines") - 1)).otherwise(F.col("_lines")))
        rows = rows.withColumn("_in", F.reverse(F.slice("_all", F.greatest(F.size("_all") - max_lines + 1, F.lit(1)), F.lit(max_lines))))
    else:
        rows = rows.withColumn("_all", F.col("_lines")).withColumn("_in", F.slice("_lines", 1, max_lines))
    rows = rows.withColumn("total_lines", F.size("_all").cast("long")).withColumn("total_bytes", F.octet_length(F.array_join("_lines", "\n")).cast("long")).withColumn("_fit", fitting(F.col("_in"), max_lines, max_bytes))
    whole = (F.col("total_lines") <= max_lines) & (F.col("total_bytes") <= max_bytes)
    kept = F.slice("_in", F.lit(1), F.col("_fit.n").cast("int"))
    kept = F.array_join(F.reverse(kept) if side == "tail" else kept, "\n")
    none = ~whole & (F.col("_fit.n") == 0)
    text = F.when(whole, F.array_join("_lines", "\n")).otherwise(kept)
    if side == "tail":
        text = F.when(none, end_of_line(F.element_at("_all", -1), max_bytes)).otherwise(text)
    rows = rows.withColumn("text", text)
    lines = F.when(whole, F.col("total_lines")).when(none & F.lit(side == "tail"), 1).otherwise(F.col("_fit.n"))
    by = F.when(whole, "none").when((F.col("_fit.n") >= max_lines) | (F.col("_fit.n") == F.col("total_lines")), "lines").otherwise("bytes")
    return rows.withColumns({"lines": lines.cast("long"), "bytes": F.octet_length("text").cast("long"), "truncated_by": by, "first_too_long": none})


def truncate_lines(docs: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, side: str = "head", key: str = "doc_id") -> DataFrame:
    """Whole leading (or trailing) lines within both limits, and an account: one row a document with a text, nothing shuffled.

    A line's size is its bytes and a line feed, the kept ones' last without. ``first_too_long``: not even one line fits; ``tail``
    then keeps the end of that line that fits, from a character's start, and counts it as a line.
    """
    rows = docs.filter("text IS NOT NULL").select(key, F.split(feeds("text"), "\n").alias("_lines"))
    return truncated(rows, max_lines, max_bytes, side).select(key, "total_lines", "total_bytes", "lines", "bytes", "text", "truncated_by", "first_too_long")


def read_slice(docs: DataFrame, offset: int = 1, limit: int | None = None, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, key: str = "doc_id") -> DataFrame:
    """Lines from ``offset`` (1: the first) on, at most ``limit``, then truncated; with what remains and the next offset.

    ``past_end``: the document has fewer lines than the offset. Nothing is shuffled.
    """
    every = F.split(feeds("text"), "\n")
    rows = docs.filter("text IS NOT NULL").select(key, F.size(every).cast("long").alias("document_lines"), F.slice(every, offset, 2**31 - 1 if limit is None else limit).alias("_lines"))
    rows = truncated(rows, max_lines, max_bytes, "head").withColumn("past_end", F.col("document_lines") < offset)
    shown = lambda c: F.when(~F.col("past_end"), F.col(c))
    after = F.lit(offset) + F.col("lines")
    return rows.select(
        key, "document_lines", F.coalesce(shown("lines"), F.lit(0)).cast("long").alias("lines"), F.coalesce(shown("bytes"), F.lit(0)).alias("bytes"), shown("text").alias("text"), shown("truncated_by").alias("truncated_by"), "past_end",
        F.when(~F.col("past_end") & (after <= F.col("document_lines")), after).alias("next_offset"),
    )


def fuzzy_score(query: str, text: str) -> float | None:
    """K5: how well the query's characters occur in order in the text; lower is better, null is no match.

    A hit right after the last one gains more the longer the run; skipped characters, and lateness, cost; word starts gain.
    """
    query, text = query.lower(), text.lower()

    def places(q: str) -> list[int] | None:
        at, out = -1, []
        for c in q:
            at = text.find(c, at + 1)
            if at < 0:
                return None
            out.append(at)
        return out

    def score(q: str) -> float | None:
        found = places(q)
        if found is None:
            return None
        gaps = [b - a - 1 for a, b in zip([-1, *found], found, strict=False)]
        total, run = 0.0, 0
        for k, (place, gap) in enumerate(zip(found, gaps, strict=True)):
            run = run + 1 if gap == 0 else 0
            total += -5 * run if run else 2 * gap * (k > 0)
            total += 0.1 * place - 10 * (place == 0 or bool(re.match(r"[\s\-_./:]", text[place - 1])))
        return total - 100 * (bool(q) and q == text)

    own = score(query)
    if own is None and (m := re.fullmatch(r"([a-z]+)([0-9]+)|([0-9]+)([a-z]+)", query)):
        parts = [p for p in m.groups() if p]
        own = score(parts[1] + parts[0])
        own = None if own is None else own + 5
    return own


def with_fuzzy_score(df: DataFrame, query: str, text: str = "text") -> DataFrame:
    """K5: rows in which every token of the query matches, with ``score``, the sum. A plain pattern drops most rows first."""
    tokens = [t for t in re.split(r"[\s/]+", query.strip()) if t]
    rows = df
    for t in tokens:
        if not re.fullmatch(r"[a-z]+[0-9]+|[0-9]+[a-z]+", t.lower()):
            rows = rows.filter(F.lower(F.col(text)).rlike("(?s)" + ".*".join(re.escape(c) for c in t.lower())))
    schema = T.StructType(list(df.schema.fields)).add("score", "double")

    def run(batches):
        for b in batches:
            scores = []
            for t in b.column(text).to_pylist():
                own = [fuzzy_score(q, t or "") for q in tokens]
                scores.append(None if None in own else float(sum(own)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    return rows.mapInArrow(run, schema).filter("score IS NOT NULL")


def parse_query(query: str) -> tuple[str, list[tuple[str, str]]] | None:
    """(regex, [..]) or (tokens, [(fuzzy or phrase, text)]); null for a pattern that doesn't compile."""
    q = query.strip()
    if q.startswith("re:"):
        pattern = q[3:].strip()
        try:
            re.compile(pattern)
        except re.error:
            return None
        return ("regex", [("regex", pattern)]) if pattern else None
    if q.count('"') % 2:
        return "tokens", [("fuzzy", t) for t in q.split()]
    out = []
    for k, part in enumerate(q.split('"')):
        out += [("phrase", part.strip())] if k % 2 and part.strip() else [("fuzzy", t) for t in part.split()] if k % 2 == 0 else []
    return "tokens", out


def search_sessions(sessions: DataFrame, query: str, sort: str = "relevance", named_only: bool = False, text: str = "text", modified: str = "modified") -> DataFrame:
    """Sessions in which all parts of a query match: ``re:`` patterns, "phrases", fuzzy words. ``score``: lower is better.

    relevance: by score, ties newest first; recent: newest first.
    """
    rows = named_sessions(sessions) if named_only else sessions
    parsed = parse_query(query)
    if parsed is None:
        return rows.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    score, kinds = F.lit(0.0), parsed[1]
    for kind, value in kinds:
        if kind == "regex":
            place = F.regexp_instr(F.col(text), F.lit("(?i)" + value))
            rows = rows.filter(F.col(text).rlike("(?i)" + value))
            score = score + (place - 1) * 0.1
        elif kind == "phrase":
            phrase = " ".join(value.lower().split())
            place = F.instr(normalise_text(text), phrase)
            rows = rows.filter(place > 0)
            score = score + (place - 1) * 0.1
    rows = rows.withColumn("_score", score)
    fuzzy = [v for k, v in kinds if k == "fuzzy"]
    if fuzzy:
        rows = with_fuzzy_score(rows, " ".join(fuzzy), text).withColumn("score", F.col("score") + F.col("_score")).drop("_score")
    else:
        rows = rows.withColumnRenamed("_score", "score")
    return rows.orderBy(*([F.asc("score")] if sort == "relevance" else []), F.desc(modified))


def session_info(entries: DataFrame) -> DataFrame:
    """A listing row: messages, first user text, all text, latest name (blank clears), created, modified.

    Columns: session_id, seq, type, role, text, and if there: name, ts. ``modified`` is the latest activity, else the first row's time.
    """
    has = set(entries.columns)
    talk = F.col("role").isin("user", "assistant") if "role" in has else F.lit(True)
    said = talk & (F.trim(F.coalesce("text", F.lit(""))) != "")
    aggs = [
        F.count_if(talk).alias("messages"),
        F.min_by("text", F.when((F.col("role") == "user") & said, F.col("seq"))).alias("first_message"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(said, F.struct("seq", "text")))), lambda x: x["text"]), " ").alias("text"),
    ]
    if "name" in has:
        aggs.append(F.nullif(F.trim(F.max_by("name", F.when(F.col("type") == "session_info", F.col("seq")))), F.lit("")).alias("name"))
    if "ts" in has:
        aggs += [F.min("ts").alias("created"), F.coalesce(F.max(F.when(talk, F.col("ts"))), F.min("ts")).alias("modified")]
    return entries.groupBy("session_id").agg(*aggs)


def list_sessions(sessions: DataFrame, cwd: str | None = None, modified: str = "modified") -> DataFrame:
    """all sessions, or those of a directory, newest first."""
    rows = sessions if cwd is None else sessions.filter(F.col("cwd") == cwd)
    return rows.orderBy(F.desc(modified), "session_id")


def most_recent_session(sessions: DataFrame, by: str = "cwd", modified: str = "modified") -> DataFrame:
    """the newest session of each directory (ties: smallest id)."""
    w = W.partitionBy(by).orderBy(F.desc(modified), "session_id")
    return sessions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def user_messages(messages: DataFrame) -> DataFrame:
    """user rows with text, in order: where a fork can begin."""
    return messages.filter((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")).orderBy("session_id", "seq")


def first_wins_dedup(df: DataFrame, key: str, order: list[Column], same: str | None = None) -> tuple[DataFrame, DataFrame]:
    """F8: (first row of each key, the other rows with ``winner``). A loser that equals the winner in ``same`` isn't reported."""
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    kept = ranked.filter("_n = 1").drop("_n")
    mark = same or key
    losers = ranked.filter("_n > 1").drop("_n").join(kept.select(key, F.col(mark).alias("winner")), key)
    return kept, losers if same is None else losers.filter(F.col(same) != F.col("winner"))

