"""Scalar Column helpers (I1-I15) and the per-row classifiers of calls and commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators and sizes of the log format.
LONG_LINE = 500
RESULT_CHARS = 2000
IMAGE_CHARS = 4800


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf16_length(x: Column | str) -> Column:
    """Length in UTF-16 units, which token estimates count."""
    return (F.octet_length(F.encode(col(x), "UTF-16BE")) / 2).cast("long")


def utf8_bytes(x: Column | str) -> Column:
    """Size in UTF-8 bytes."""
    return F.octet_length(col(x)).cast("long")


def normalise_text(x: Column | str) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(x)), r"\s+", " "))


def truncate_line(x: Column | str, most: int = LONG_LINE, marker: str = "... [truncated]") -> Column:
    """The first ``most`` characters and a marker, for longer ones."""
    x = col(x)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(marker))).otherwise(x)


def truncate_result(x: Column | str, most: int = RESULT_CHARS) -> Column:
    """The first ``most`` characters and a note of how many more there were."""
    x = col(x)
    note = F.concat(F.lit("\n\n[... "), (F.length(x) - most).cast("string"), F.lit(" more characters truncated]"))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), note)).otherwise(x)


def day_label(ts: Column | str, tz: str = "UTC") -> Column:
    """I4: calendar day in a zone, as text."""
    return F.date_format(F.from_utc_timestamp(col(ts), tz), "yyyy-MM-dd")


def week_label(ts: Column | str, tz: str = "UTC") -> Column:
    """I4: the Monday that the week in a zone begins with."""
    return F.date_format(F.date_trunc("week", F.from_utc_timestamp(col(ts), tz)), "yyyy-MM-dd")


def hour_label(ts: Column | str, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), tz), "HH")


def file_stamp(name: Column | str) -> Column:
    """Creation time from a file name like ``2025-01-31T10-20-30-123Z_id.jsonl``; null if it has none."""
    part = F.regexp_extract(col(name), r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}(?:-\d{1,3})?Z)_", 1)
    iso = F.regexp_replace(part, r"T(\d{2})-(\d{2})-(\d{2})(?:-(\d{1,3}))?Z", "T$1:$2:$3.$4Z")
    return F.when(part != "", F.try_to_timestamp(F.regexp_replace(iso, r"\.Z$", "Z")))


def any_time(epoch_ms: Column | str, iso: Column | str) -> Column:
    """A message's epoch milliseconds, else an entry's ISO text."""
    return F.coalesce(F.timestamp_millis(col(epoch_ms)), F.try_to_timestamp(col(iso)))


def quantile(x: Column | str, q: float) -> Column:
    """Linear-interpolated quantile; null on no rows."""
    return F.percentile(col(x), q)


def ratio(a: Column | str, b: Column | str) -> Column:
    """I8: null where the denominator is 0."""
    return col(a) / F.nullif(col(b), F.lit(0))


def is_alias(model_id: Column | str) -> Column:
    """A name that ends in ``-latest`` or in no date."""
    x = col(model_id)
    return x.endswith("-latest") | ~x.rlike(r"-\d{8}$")


def valid_session_id(x: Column | str) -> Column:
    """Letters, digits, dash, underscore and dot; ends with a letter or digit, and begins with one."""
    return F.coalesce(col(x).rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?$"), F.lit(False))


def distinct_except(a: Column | str, b: Column | str) -> Column:
    """Sorted members of a that b lacks."""
    return F.array_sort(F.array_except(col(a), col(b)))


def merge_maps(a: Column | str, b: Column | str) -> Column:
    """b's members win; a null value stays apart from a missing key."""
    a, b = F.coalesce(col(a), F.create_map().cast("map<string,string>")), F.coalesce(col(b), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def level_state(levels: Column | str, key: str) -> Column:
    """``unsupported`` for a null value, ``default`` for a missing key, else the value."""
    m = col(levels)
    return F.when(~F.coalesce(F.map_contains_key(m, key), F.lit(False)), "default").otherwise(F.coalesce(F.try_element_at(m, F.lit(key)), F.lit("unsupported")))


def json_value(raw: Column | str, path: str, kind: str = "string") -> Column:
    """A typed member of a JSON variant; null if it is missing or of another type."""
    return F.try_variant_get(col(raw), path, kind)


def size_label(n: Column | str) -> Column:
    """B, KB or MB with one digit."""
    n = col(n)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, 1), F.lit("KB"))).otherwise(F.concat(F.format_number(n / 1048576, 1), F.lit("MB")))


def percent_label(x: Column | str, digits: int = 1) -> Column:
    return F.when(col(x).isNull(), "n/a").otherwise(F.concat(F.format_number(col(x) * 100, digits), F.lit("%")))


def estimate(chars: Column) -> Column:
    """Tokens of so many characters: a quarter, rounded up."""
    return F.ceil(chars / 4.0).cast("long")


def provider_model(provider: Column | str, model: Column | str, response_model: Column | str | None = None) -> Column:
    """``provider/model``, [unknown] for what is missing; a response's own model name wins."""
    m = F.coalesce(*([col(response_model)] if response_model is not None else []), col(model), F.lit("[unknown]"))
    return F.concat(F.coalesce(col(provider), F.lit("[unknown]")), F.lit("/"), m)


def path_extension(path: Column | str) -> Column:
    """Lower-cased extension; a dot file's name; [no_ext]; [unknown]."""
    base = F.element_at(F.split(F.regexp_replace(col(path), r"/+$", ""), "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"[^.].*?(\.[^.]*)$", 1))
    return F.when(F.coalesce(F.length(col(path)), F.lit(0)) == 0, "[unknown]").when(ext != "", ext).when(base.startswith("."), F.lower(base)).otherwise("[no_ext]")


#: What ends a command's first segment; assignments and sudo before its program, and an argument.
SEGMENT_END = r"\n|&&|\|\||;|\|"
PROGRAM = r"^(?:\w+=\S+\s+)*(?:sudo\s+)?(\S+)(?:\s+(\S+))?"


def command_key(command: Column | str) -> Column:
    """Program and first plain argument of a command's first segment, past assignments and sudo."""
    first = F.trim(F.element_at(F.split(col(command), SEGMENT_END), 1))
    program, argument = F.regexp_extract(first, PROGRAM, 1), F.regexp_extract(first, PROGRAM, 2)
    named = F.when((argument != "") & ~argument.startswith("-"), F.concat(program, F.lit(" "), argument)).otherwise(program)
    return F.when(F.coalesce(program, F.lit("")) == "", "unknown").otherwise(named)


def read_mode(offset: Column | str, limit: Column | str) -> Column:
    """Partial if a read names an offset or a limit."""
    return F.when(col(offset).isNotNull() | col(limit).isNotNull(), "partial").otherwise("full")


def edit_style(arguments: Column | str) -> dict[str, Column]:
    """Style, mode and number of edits of an edit call's arguments (variant)."""
    has = lambda p: F.try_variant_get(col(arguments), p, "string").isNotNull()
    edits = F.try_variant_get(col(arguments), "$.edits", "array<variant>")
    new_style, old_style = has("$.oldText") | has("$.newText"), has("$.old_string") | has("$.new_string")
    style = F.when(edits.isNotNull(), "edits").when(new_style & old_style, "mixed").when(new_style, "oldText/newText").when(old_style, "old_string/new_string").otherwise("unknown")
    return {"arg_style": style, "mode": F.when(edits.isNotNull(), "multi").otherwise("single"), "edits_count": F.when(edits.isNotNull(), F.size(edits)).otherwise(1).cast("long")}


#: Failure classes in order, by what a lower-cased error text holds.
ERROR_KINDS = [
    ("file_not_found", "file not found"),
    ("not_found_exact_text", "could not find the exact text"),
    ("multiple_occurrences", "found multiple occurrences"),
    ("no_changes_made", "no changes made"),
    ("invalid_input", "input is invalid"),
    ("overlapping_edits", "must not overlap"),
    ("aborted", "aborted"),
]


def error_kind(text: Column | str, is_error: Column | str, matched: Column | str) -> Column:
    """Class of a failed edit's result; null for a success, ``missing_result`` without a result."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.when(~col(matched), "missing_result").when(~F.coalesce(col(is_error), F.lit(False)), F.lit(None).cast("string"))
    for kind, words in ERROR_KINDS:
        hit = t.contains(words)
        out = out.when(hit | t.rlike(r"(?m)^found \d+ occurrences") if kind == "multiple_occurrences" else hit, kind)
    return out.otherwise("other")


def content_text(content: Column | str, separator: str = "\n", mode: str = "text", of: Callable[[Column], Column] | None = None) -> Column:
    """The text of an array of blocks. mode ``text``: text blocks only; ``all``: images' data and other blocks as JSON too."""
    blocks = col(content)
    if mode == "text":
        return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), of or (lambda b: F.coalesce(b["text"], F.lit("")))), separator)
    return F.array_join(F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "image", b["data"]).otherwise(F.to_json(b))), separator)
