"""Can batches of text edits be applied to the documents of a corpus, and where. Grain of edits: one row an edit, key (doc_id, edit_no)."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: What counts as blank at the end of a line, and the characters that fuzzy matching takes for plain ones.
BLANK = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PLAIN = {
    **dict.fromkeys([0x2018, 0x2019, 0x201A, 0x201B], "'"),
    **dict.fromkeys([0x201C, 0x201D, 0x201E, 0x201F], '"'),
    **dict.fromkeys([*range(0x2010, 0x2016), 0x2212], "-"),
    **dict.fromkeys([0xA0, *range(0x2002, 0x200B), 0x202F, 0x205F, 0x3000], " "),
}
#: Edits of one document that one task takes at a time.
PER_TASK = 10_000


def line_feeds(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def fuzzy_form(text: str) -> str:
    """Text as fuzzy matching sees it: NFKC, no blanks at line ends, plain quotes, dashes and spaces."""
    return "\n".join(x.rstrip(BLANK) for x in unicodedata.normalize("NFKC", text).split("\n")).translate(PLAIN)


def pieces(line: str) -> list[tuple[int, int, str]]:
    """(start, end, NFKC form) of the shortest parts of a line that are normalised by themselves."""
    out: list[tuple[int, int, str]] = []
    for k, c in enumerate(line):
        form = unicodedata.normalize("NFKC", c)
        if out:
            start, _, before = out[-1]
            alone = c.isascii() or (not unicodedata.combining(unicodedata.normalize("NFKD", c)[0]) and unicodedata.normalize("NFKC", line[start:k] + c) == before + form)
            if not alone:
                out[-1] = (start, k + 1, unicodedata.normalize("NFKC", line[start : k + 1]))
                continue
        out.append((k, k + 1, form))
    return out


class Offsets:
    """A form of a text, and where each of its characters begins and ends in the text as stored.

    Kept as runs: inside a run places grow alike, unless the run is one character (or what becomes of it).
    """

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.at: list[int] = []  # first place of each run in the form
        self.runs: list[tuple[int, int, bool]] = []  # its place and end in the text, and whether places grow alike

    def add(self, form: str, start: int, end: int, alike: bool) -> None:
        if form:
            if alike and self.runs and self.runs[-1][2] and self.runs[-1][1] == start:
                self.runs[-1] = (self.runs[-1][0], end, True)
            else:
                self.at.append(self.size)
                self.runs.append((start, end, alike))
            self.parts.append(form)
            self.size += len(form)

    def text(self) -> str:
        return "".join(self.parts)

    def span(self, start: int, size: int) -> tuple[int, int]:
        """(start, size) in the stored text of ``size`` characters of the form: whole stored characters, also where one became several."""
        k = bisect_right(self.at, start) - 1
        low, high, alike = self.runs[k] if k >= 0 else (0, 0, False)
        low = low + start - self.at[k] if alike else low
        if not size:
            return low, 0
        k = bisect_right(self.at, start + size - 1) - 1
        first, high, alike = self.runs[k]
        return low, (first + start + size - self.at[k] if alike else high) - low


def forms(stored: str) -> tuple[Offsets, Offsets]:
    """A stored text with line feeds only, and its fuzzy form. A byte order mark at the beginning isn't text."""
    exact, fuzzy = Offsets(), Offsets()
    at = 1 if stored.startswith("\ufeff") else 0
    while True:
        # the next line, and its end as stored: CRLF, CR or LF
        ends = [x for x in (stored.find("\n", at), stored.find("\r", at)) if x >= 0]
        end = min(ends, default=len(stored))
        line = stored[at:end]
        exact.add(line, at, end, True)
        if unicodedata.is_normalized("NFKC", line):
            kept = line.rstrip(BLANK)
            fuzzy.add(kept.translate(PLAIN), at, at + len(kept), True)
        else:
            parts = pieces(line)
            left = len("".join(p[2] for p in parts).rstrip(BLANK))
            for a, b, form in parts:
                form = form[: max(left, 0)]
                left -= len(form)
                fuzzy.add(form.translate(PLAIN), at + a, at + b, len(form) == 1 == b - a)
        if end == len(stored):
            return exact, fuzzy
        at = end + (2 if stored.startswith("\r\n", end) else 1)
        exact.add("\n", end, at, at == end + 1)
        fuzzy.add("\n", end, at, at == end + 1)


def found(text: str, wanted: set[str]) -> dict[str, tuple[int, int]]:
    """(first place, times without overlap) of each wanted text that occurs, in one pass of an automaton."""
    wanted = {w for w in wanted if w}
    if not wanted or not text:
        return {}
    automaton = ahocorasick.Automaton()
    for w in wanted:
        automaton.add_word(w, w)
    automaton.make_automaton()
    out: dict[str, tuple[int, int]] = {}
    free: dict[str, int] = {}
    for last, w in automaton.iter(text):
        start = last - len(w) + 1
        if w not in out:
            out[w], free[w] = (start, 1), last + 1
        elif start >= free[w]:
            out[w], free[w] = (out[w][0], out[w][1] + 1), last + 1
    return out


def matches(stored: str | None, olds: list[str | None]) -> list[tuple]:
    """For each edit: (found as written, times in the fuzzy form, then in the text with line feeds and in the fuzzy form: place, size, and both as stored)."""
    exact, fuzzy = forms(stored or "")
    plain, loose = exact.text(), fuzzy.text()
    olds = [line_feeds(o or "") for o in olds]
    loose_olds = [fuzzy_form(o) for o in olds]
    in_plain, in_loose = found(plain, set(olds)), found(loose, {*olds, *loose_olds})
    units = len(loose.encode("utf-16-le", "surrogatepass")) // 2
    out = []
    for o, lo in zip(olds, loose_olds, strict=True):
        if not o or stored is None:
            out.append((False, 0, *[None] * 8))
            continue
        a = in_plain.get(o)
        # in the fuzzy form, the text as written comes first there too; one that has become empty is found at the beginning
        b = (in_loose[o][0], len(o)) if o in in_loose else (in_loose[lo][0], len(lo)) if lo in in_loose else None if lo else (0, 0)
        times = in_loose.get(lo, (0, 0))[1] if lo else max(units - 1, 0)
        out.append((a is not None, times, *((a[0], len(o), *exact.span(a[0], len(o))) if a else [None] * 4), *((*b, *fuzzy.span(*b)) if b else [None] * 4)))
    return out


def check_edits(edits: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each edit (key, edit_no, old) with ``status``, ``start``, ``size``, ``occurrences`` and ``overlaps``.

    A document's edits are matched as one batch: as written if all are found so (CRLF and CR count as line feeds), else all in the
    fuzzy form of the text. ``status``: exact, fuzzy (found in that form only), multiple (more than one occurrence in the fuzzy form), not_found
    or empty. ``start`` (from 0) and ``size`` are characters of the text as stored, whatever form it was found in. ``overlaps``: an edit that
    can be applied begins, in the form that its batch is matched in, before one before it ends.

    Edits of a document come to a task some ``PER_TASK`` at a time, with one copy of its text, so no text is joined to each edit. A
    null or empty ``old`` is empty; a document that the corpus lacks, or whose text is null, has no matches. One row a document in ``corpus``.
    """
    given = list(edits.columns)
    parts = F.greatest(F.ceil(F.count("*") / PER_TASK), F.lit(1)).cast("int")
    counts = edits.filter(F.col(key).isNotNull()).groupBy(key).agg(parts.alias("_parts"))
    rows = edits.join(counts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("edit_no", "old"), F.col("_parts")), F.pmod(F.xxhash64("edit_no", "old"), F.lit(1 << 20))).cast("int")).drop("_parts")
    texts = corpus.select(F.col(key).alias("_key"), "text").join(counts.select(F.col(key).alias("_key"), "_parts"), "_key").select("_key", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "text")
    added = ["_as_written", "occurrences", *(f"_{form}_{x}" for form in ("plain", "loose") for x in ("at", "size", "start", "stored"))]
    schema = T.StructType([*edits.schema, T.StructField("_as_written", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in added[1:])])

    types = [pa.bool_(), *[pa.int64()] * (len(added) - 1)]

    def run(batches):
        for b in batches:
            own, first, values = pa.RecordBatch.from_struct_array(b.column("_own").flatten()), 0, []
            olds = own.column("old")
            for stored, size in zip(b.column("text"), b.column("_own").value_lengths().to_pylist(), strict=True):
                at = first + len(values)
                values += matches(stored.as_py(), olds.slice(at, size).to_pylist())
                if len(values) >= PER_TASK or at + size == own.num_rows:
                    here = own.slice(first, len(values))
                    new = [pa.array(v, t) for v, t in zip(zip(*values, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(here.column(c) for c in given), *new], names=[*given, *added])
                    first, values = first + len(values), []

    # a row for some PER_TASK edits of a document, with its text: batches hold many documents, no group is handed over by itself
    own = rows.groupBy(key, "_part").agg(F.collect_list(F.struct(*given)).alias("_own"))
    texts = texts.dropDuplicates(["_key", "_part"]).withColumnRenamed("_part", "_text_part")
    joined = own.join(texts, (own[key] == texts["_key"]) & (own["_part"] == texts["_text_part"]), "left").select("_own", "text")
    out = joined.mapInArrow(run, schema)
    batch = W.partitionBy(key)
    loose = F.col("_loose_at").isNotNull()
    out = out.withColumn("_batch_loose", F.max(F.col("_as_written").eqNullSafe(False) & loose).over(batch))
    pick = lambda x: F.when(F.col("_batch_loose"), F.col(f"_loose_{x}")).otherwise(F.when(F.col("_as_written"), F.col(f"_plain_{x}")))
    out = out.withColumns({f"_{x}": pick(x) for x in ("at", "size", "start", "stored")})
    blank = F.coalesce(F.length("old"), F.lit(0)) == 0
    status = F.when(blank, "empty").when(F.col("_at").isNull(), "not_found").when(F.col("occurrences") > 1, "multiple").when(F.col("_as_written"), "exact").otherwise("fuzzy")
    out = out.withColumn("status", status)
    usable = F.col("status").isin("exact", "fuzzy")
    before = batch.orderBy(F.when(usable, F.col("_at")), "edit_no").rowsBetween(W.unboundedPreceding, -1)
    end = F.max(F.when(usable, F.col("_at") + F.col("_size"))).over(before)
    return out.withColumn("overlaps", F.coalesce(usable & (F.col("_at") < end), F.lit(False))).select(*given, "status", F.col("_start").alias("start"), F.col("_stored").alias("size"), "occurrences", "overlaps")
