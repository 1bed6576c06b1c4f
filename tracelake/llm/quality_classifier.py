"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one binned feature after the other; each feature ends up with a lookup table over its
bins. The pairs with the most gain left get two-way tables the same way. A score is the sum of looked-up values.

Training reads a bounded sample of labelled rows (some ``max_rows``, by id hash); everything else covers all rows.
Defined cases: a null text counts as empty, and empty texts have features of 0 and get a score; a null id is never held out.
Null labels are left out; repeated labels of an id vote by mean (a tie: good). Without labels of both kinds the score is the label
mean. Repeated rows are scored one by one and alike; of equal gains the first cut and the first pair of features win; a value on a
cut belongs below it. Texts of any length are read whole; only ``keep`` columns are carried along, so others may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, words_of, written

FEATURES = ("log_words", "word_size", "symbols", "digits", "capitals", "shouts", "bars", "sentences", "dup_lines", "line_size", "distinct_words")
WHITE = " \t\n\x0b\x0c\r"


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One narrow row of ratios for each document, over its whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))

    def count(chars: str) -> Column:
        return F.length("_t") - F.length(F.translate("_t", chars, ""))

    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    base = docs.select(*keep, t.alias("_t"), words_of(t).alias("_w"), lines.alias("_l"))
    words, chars, n_lines = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length(F.translate("_t", WHITE, "")), F.lit(1)), F.greatest(F.size("_l"), F.lit(1))
    values = {
        "log_words": F.log1p(F.size("_w")),
        "word_size": F.length(F.translate("_t", WHITE, "")) / words,
        "symbols": count("#*$%&<>") / words,
        "digits": count("0123456789") / chars,
        "capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ") / chars,
        "shouts": count("!") / words,
        "bars": count("|") / words,
        "sentences": count(".?") / words,
        "dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))) / n_lines,
        "line_size": F.log1p(F.size("_w") / n_lines),
        "distinct_words": F.size(F.array_distinct("_w")) / words,
    }
    return base.select(*keep, *(values[k].cast("double").alias(k) for k in FEATURES))


def _leaves(grad: np.ndarray, hess: np.ndarray, depth: int, reg: float) -> np.ndarray:
    """A regression tree over ordered bins: the value of the leaf each bin falls in."""
    g, h = grad.sum(), hess.sum()
    if depth and len(grad) > 1:
        gl, hl = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        gain = gl**2 / (hl + reg) + (g - gl) ** 2 / (h - hl + reg) - g**2 / (h + reg)
        k = int(np.argmax(gain))
        if gain[k] > 1e-9:
            return np.concatenate([_leaves(grad[: k + 1], hess[: k + 1], depth - 1, reg), _leaves(grad[k + 1 :], hess[k + 1 :], depth - 1, reg)])
    return np.full(len(grad), g / (h + reg))


def _quadrants(grad: np.ndarray, hess: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """The best cut on both axes of a two-way histogram: each cell's value, and the gain."""
    g, h = np.cumsum(np.cumsum(grad, 0), 1), np.cumsum(np.cumsum(hess, 0), 1)
    parts_g = np.stack([g, g[:, -1:] - g, g[-1:] - g, g[-1, -1] - g[:, -1:] - g[-1:] + g])
    parts_h = np.stack([h, h[:, -1:] - h, h[-1:] - h, h[-1, -1] - h[:, -1:] - h[-1:] + h])
    gain = (parts_g**2 / (parts_h + reg)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = parts_g[:, i, j] / (parts_h[:, i, j] + reg)
    low_i, low_j = np.arange(grad.shape[0])[:, None] <= i, np.arange(grad.shape[1])[None] <= j
    return np.where(low_i, np.where(low_j, v[0], v[1]), np.where(low_j, v[2], v[3])), float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, pairs: int = 4, rounds: int = 120, rate: float = 0.1, depth: int = 2, reg: float = 2.0) -> dict:
    """Boosts the tables. ``x`` rows by features, ``y`` 0/1."""
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    model: dict = {"base": float(np.log(mean / (1 - mean))), "cuts": [], "tables": [], "pairs": []}
    for k in range(x.shape[1]):
        q = np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]) if len(y) else np.empty(0)
        model["cuts"].append(np.unique(q))
        model["tables"].append(np.zeros(len(model["cuts"][k]) + 1))
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(model["cuts"][k], x[:, k]) for k in range(x.shape[1])]
    f = np.full(len(y), model["base"])

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(at):
            g, h = slope()
            step = rate * _leaves(np.bincount(b, g, len(model["tables"][k])), np.bincount(b, h, len(model["tables"][k])), depth, reg)
            model["tables"][k] += step
            f += step[b]
    coarse = [np.unique(c[np.linspace(0, len(c) - 1, pair_bins - 1).astype(int)]) if len(c) else c for c in model["cuts"]]
    small = [np.searchsorted(c, x[:, k]) for k, c in enumerate(coarse)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape, cell = (len(coarse[i]) + 1, len(coarse[j]) + 1), small[i] * (len(coarse[j]) + 1) + small[j]
        g, h = slope()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    best = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(*grids(*p), reg)[1])[:pairs]
    model["pairs"] = [{"of": p, "cuts": (coarse[p[0]], coarse[p[1]]), "table": np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1))} for p in best]
    for _ in range(rounds // 2):
        for p in model["pairs"]:
            i, j = p["of"]
            step = rate * _quadrants(*grids(i, j), reg)[0]
            p["table"] += step
            f += step[small[i], small[j]]
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Sum of the looked-up values, as a chance."""
    f = np.full(len(x), model["base"])
    for k, (cuts, table) in enumerate(zip(model["cuts"], model["tables"], strict=True)):
        f += table[np.searchsorted(cuts, x[:, k])]
    for p in model["pairs"]:
        i, j = p["of"]
        f += p["table"][np.searchsorted(p["cuts"][0], x[:, i]), np.searchsorted(p["cuts"][1], x[:, j])]
    return 1 / (1 + np.exp(-f))


def train(table: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> dict:
    """Fits on some ``max_rows`` labelled rows of the training folds at most: those whose id hash lies in that share of all hashes; one row an id."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    # one row an id, so that an id on very many rows is one row of the sample too
    rows = table.join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("f"), F.first("_y").alias("_y")).select("doc_id", "f.*", "_y")
    n = rows.count()
    if n > max_rows:  # a share of the hash space, so that no task sends more than its share
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = rows.select("doc_id", *FEATURES, "_y").toPandas().sort_values(["doc_id", *FEATURES])
    return fit(rows[list(FEATURES)].to_numpy(float), rows["_y"].to_numpy(float))


def score(table: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``table`` holds FEATURES and ``keep``; the result has keep, held_out, score and predicted."""
    schema = table.select(*keep).schema.add("score", "double")

    def run(batches):
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in FEATURES], 1) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(scores(model, x))], names=[*keep, "score"])

    out = table.select(*keep, *FEATURES).mapInArrow(run, schema)
    return out.select(*keep, held_out().alias("held_out") if "doc_id" in keep else F.lit(False).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    table = written(features(read_table(spark, sf_dir, "documents")), "classifier-features")
    return score(table, train(table, read_table(spark, sf_dir, "labels")))
