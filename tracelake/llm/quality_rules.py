"""Quality rules: weak supervision with DataFrame functions only.

Rules vote good, bad or abstain on every document. Expectation-maximisation over the counted vote patterns estimates how
often each rule is right about good and about bad documents, and the posterior replaces all-must-pass filtering.

Defined cases: a null or empty text has no words, so every count is 0, ``base_failed`` is true and ``kept`` false. Repeated
rows are judged one by one. An empty table gives an empty result. Further columns of the input are not carried over.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of ``window`` words that the array holds twice or more."""

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce(a == b, F.lit(False))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda o: F.filter(o, lambda x, k: equal(F.get(o, k - 1)["h"], x["h"]) | equal(F.get(o, k + 1)["h"], x["h"]))
        return let(let(ordered, lambda o: F.sort_array(F.transform(twice(o), lambda x: x["i"]))), width)

    def width(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def of(w: Column) -> Column:
        n = F.size(w) - window + 1
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, window)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(some)

    return let(words, of)


def features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of every whole text, one narrow row a document."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    marked = F.regexp_count(t, F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|$)"))
    return docs.select(F.col(key), t.alias("_t"), words_of(t).alias("_w"), lines.alias("_l"), marked.cast("long").alias("n_marked")).select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        "n_marked",
        F.size(F.filter("_w", lambda w: F.length(F.translate(w, SYMBOLS + ".,!?", "")) == 0)).cast("long").alias("n_bare"),
        count(".?").alias("n_ends"),
        count(CAPITALS).alias("n_upper"),
        count("!").alias("n_shouts"),
    )


def count(chars: str) -> Column:
    return (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")


def rules() -> dict[str, tuple[Column, Column]]:
    """Each rule's good and bad votes over :func:`features`; where neither holds it abstains."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    return {
        "length": (c("n_words") >= 50, c("n_words") < 20),
        "symbols": (100 * c("n_symbols") <= 2 * n, 10 * c("n_symbols") > n),
        "marked_words": (100 * c("n_marked") <= n, 100 * c("n_marked") > 8 * n),
        "bare_words": (c("n_bare") * 50 <= n, c("n_bare") * 10 > n),
        "capitals": (10 * c("n_upper") <= c("word_chars"), 10 * c("n_upper") > 4 * c("word_chars")),
        "shouts": (20 * c("n_shouts") <= n, 10 * c("n_shouts") > 3 * n),
        "repetition": ((c("n_dup_lines") == 0) & (20 * c("n_repeat_words") <= n), (10 * c("n_dup_lines") > 3 * c("n_lines")) | (5 * c("n_repeat_words") > n)),
        "sentences": ((c("n_ends") * 60 >= n) & (c("n_ends") * 2 <= n), (c("n_ends") * 200 < n) | (c("n_ends") > n)),
    }


def fit(patterns: DataFrame, names: list[str], rounds: int = 30, weight: float = 0.02) -> dict:
    """EM over ``patterns(<names> 1/0/null, rows)``, which holds at most 3^rules rows, in one expression. Returns prior and accuracies.

    ``right[1][r]`` is the chance that rule ``r`` votes good on a good document, ``right[0][r]`` that it votes bad on a bad one.
    Pseudo-counts worth ``weight`` of all rows hold them near 0.97 and 0.4, so that one kind of fault, of which several
    rules see the same sign, doesn't become the only kind.
    """
    m = len(names)
    every = patterns.agg(F.collect_list(F.struct(F.array(*(F.col(r).cast("int") for r in names)).alias("v"), F.col("rows").cast("double").alias("rows"))).alias("all"), F.coalesce(F.sum("rows"), F.lit(0)).cast("double").alias("n"))

    def total(items: Column, what) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + what(x))

    def step(model: Column) -> Column:
        def odds(p: Column) -> Column:
            by_rule = F.transform(
                p["v"],
                lambda v, r: F.when(v == 1, F.log(F.get(model["good"], r) / (1 - F.get(model["bad"], r)))).when(v == 0, F.log((1 - F.get(model["good"], r)) / F.get(model["bad"], r))).otherwise(F.lit(0.0)),
            )
            return F.log(model["prior"] / (1 - model["prior"])) + total(by_rule, lambda x: x)

        def update(judged: Column) -> Column:
            w, every_rule = F.lit(weight) * F.col("n") + 1, F.sequence(F.lit(0), F.lit(m - 1))

            def share(r: Column, vote: int, of: str, mean: float) -> Column:
                hit = total(judged, lambda x: F.when(F.get(x["v"], r) == vote, x[of]).otherwise(F.lit(0.0)))
                voted = total(judged, lambda x: F.when(F.get(x["v"], r).isNotNull(), x[of]).otherwise(F.lit(0.0)))
                return (hit + mean * w) / (voted + w)

            return F.struct(
                ((total(judged, lambda x: x["g"]) + 0.85 * w) / (F.col("n") + w)).alias("prior"),
                F.transform(every_rule, lambda r: share(r, 1, "g", 0.97)).alias("good"),
                F.transform(every_rule, lambda r: share(r, 0, "b", 0.4)).alias("bad"),
            )

        def judge_one(p: Column) -> Column:
            return let(1 / (1 + F.exp(-odds(p))), lambda q: F.struct(p["v"].alias("v"), (p["rows"] * q).alias("g"), (p["rows"] * (1 - q)).alias("b")))

        return let(F.transform(F.col("all"), judge_one), update)

    start = F.struct(F.lit(0.85).alias("prior"), F.array_repeat(F.lit(0.97), m).alias("good"), F.array_repeat(F.lit(0.4), m).alias("bad"))
    found = every.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda acc, _: step(acc)).alias("model")).first()["model"]
    return {"prior": round(found["prior"], 9), "right": {1: {r: round(x, 9) for r, x in zip(names, found["good"], strict=True)}, 0: {r: round(x, 9) for r, x in zip(names, found["bad"], strict=True)}}}


def posterior(model: dict) -> Column:
    """Chance that a row with the vote columns is good."""
    odds = F.lit(log(model["prior"] / (1 - model["prior"])))
    for r in model["right"][1]:
        good, bad = model["right"][1][r], model["right"][0][r]
        odds = odds + F.when(F.col(r) == 1, F.lit(log(good / (1 - bad)))).when(F.col(r) == 0, F.lit(log((1 - good) / bad))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def score_pattern(model: dict, votes: dict[str, int | None]) -> float:
    """The same posterior for one row of votes, for tests and reports."""
    odds = log(model["prior"] / (1 - model["prior"]))
    for r, v in votes.items():
        good, bad = model["right"][1][r], model["right"][0][r]
        odds += {1: log(good / (1 - bad)), 0: log((1 - good) / bad), None: 0.0}[v]
    return 1 / (1 + exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5, rounds: int = 30) -> DataFrame:
    """Features, base verdict, votes, posterior ``p_quality`` and ``kept`` of every document."""
    votes = rules()
    table = features(docs).select("*", *(F.when(good, 1).when(bad, 0).alias(r) for r, (good, bad) in votes.items()))
    table = written(table, "quality-features")
    patterns = written(table.groupBy(*votes).agg(F.count("*").alias("rows")).coalesce(1), "quality-patterns")
    model = fit(patterns, list(votes), rounds)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return table.withColumn("base_failed", failed).withColumn("p_quality", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= threshold))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_quality", 6).alias("p_quality"))
