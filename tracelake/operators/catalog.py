"""Model catalogs. Grain: one row a model, key (provider, model)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracelake.functions.scalars import is_alias, merge_maps
from tracelake.functions.storage import written

KEY = ["provider", "model"]
#: What a missing window means, and the thinking levels.
DEFAULT_WINDOW = 4096
LEVELS = ("off", "minimal", "low", "medium", "high", "xhigh", "max")


def normalize_catalog_prices(raw: DataFrame, prices: Sequence[str] = ("input", "output", "cache_read", "cache_write")) -> DataFrame:
    """Dollars a token to dollars a million, of 6 digits; missing windows get the default; models without tools are left out;
    input modalities: text, and image where the model takes images; context tiers need a type and a size.

    Columns used if there: context_window, max_tokens, tools, modalities, tiers (array of structs type, size, and prices).
    """
    has = set(raw.columns)
    out = raw.filter(F.coalesce("tools", F.lit(False))) if "tools" in has else raw
    out = out.withColumns({p: F.round(F.coalesce(F.col(p).cast("double"), F.lit(0.0)) * 1_000_000, 6) for p in prices if p in has})
    out = out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(DEFAULT_WINDOW)) for c in ("context_window", "max_tokens") if c in has})
    if "modalities" in has:
        out = out.withColumn("modalities", F.when(F.coalesce(F.array_contains("modalities", "image"), F.lit(False)), F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text"))))
    if "tiers" in has:
        out = out.withColumn("tiers", F.filter("tiers", lambda t: (t["type"] == "context") & (t["size"] > 0)))
    return out


def long_context_tiers(catalog: DataFrame, threshold: int, input_factor: float = 2.0, output_factor: float = 1.5) -> DataFrame:
    """Adds ``tiers`` with one tier above a threshold: twice the input and cache prices, one and a half times the output's."""
    rates = {c: output_factor if c == "output" else input_factor for c in ("input", "output", "cache_read", "cache_write") if c in catalog.columns}
    return catalog.withColumn("tiers", F.array(F.struct(F.lit(threshold).cast("long").alias("above"), *((F.col(c) * f).alias(c) for c, f in rates.items()))))


def diff_catalogs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(provider, model, change): added, removed or changed, by comparison of whole rows."""
    rest = [c for c in before.columns if c not in KEY]
    a = before.select(*KEY, F.struct(*rest).alias("_a"))
    b = after.select(*KEY, F.struct(*rest).alias("_b"))
    out = a.join(b, KEY, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return out.select(*KEY, change.alias("change")).filter("change IS NOT NULL")


def overlay_catalog(base: DataFrame, overrides: DataFrame, maps: Sequence[str] = ()) -> DataFrame:
    """Fields that an override names win; map fields are merged by key, the override's keys winning."""
    fields = [c for c in overrides.columns if c not in KEY and c in base.columns]
    own = overrides.select(*KEY, *(F.col(c).alias(f"_{c}") for c in fields))
    out = base.join(own, KEY, "left")
    return out.withColumns({c: merge_maps(c, f"_{c}") if c in maps else F.coalesce(f"_{c}", c) for c in fields}).select(*base.columns)


def union_catalogs(sources: Sequence[DataFrame], wins: str = "first", exclude: DataFrame | None = None) -> DataFrame:
    """H2: one row a model out of catalogs in order of priority, of the first (or last) source that has it; excluded ones are left out."""
    every = None
    for k, s in enumerate(sources):
        own = s.withColumn("_source", F.lit(k))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    if exclude is not None:
        every = every.join(exclude, KEY, "left_anti")
    order = F.asc("_source") if wins == "first" else F.desc("_source")
    return every.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(order))).filter("_n = 1").drop("_n", "_source")


#: Lengths of the runs of letters by which longer texts are looked up: the longest that a text has.
RUNS = (48, 24, 12, 6, 3)


def grams_of(models: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Postings of all runs of some lengths: (no, kind, pos, gram). ``kind``: the full name, or the display name; ``pos`` from 1."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("_text")) for k, c in (("full", "full"), ("name", "name"))))
    rows = models.select("no", F.explode(kinds).alias("k")).select("no", "k.*").filter("_text != ''")
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("_text"))))
    run = lambda n: F.when(F.col("pos") + (n - 1) <= F.length("_text"), F.substring(F.col("_text"), F.col("pos"), F.lit(n)))
    return rows.select("no", "kind", "pos", F.explode(F.array_compact(F.array(*map(run, lengths)))).alias("gram"))


def gram_counts(models: DataFrame) -> DataFrame:
    """How many postings each run of one, two and three letters has, ``n``, and how many of them in full names, ``n_full``."""
    return written(grams_of(models, (1, 2, 3)).groupBy("gram").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "full").alias("n_full")), "model-gram-counts")


def widened(text: str, offset: str) -> tuple[Column, Column]:
    """(gram, offset): the run of a text, as long as ``RUNS`` has it, about the three letters at an offset from 0. Shorter texts are their own run."""
    length, size = F.length(text), F.lit(None).cast("int")
    for n in RUNS:
        size = F.coalesce(size, F.when(length >= n, n))
    start = F.greatest(F.lit(0), F.least(F.col(offset) - F.floor((size - 3) / 2).cast("int"), length - size))
    return F.coalesce(F.substring(F.col(text), start + 1, size), F.col(text)), F.coalesce(start, F.lit(0))


def best_of(found: DataFrame, *key: str) -> DataFrame:
    """The model that partial matching prefers for each key: undated before dated, then the highest id, then the first provider."""
    one = found.groupBy(*key, "model").agg(F.min("provider").alias("provider"))
    return one.groupBy(*key).agg(F.max(F.struct(is_alias(F.lower(F.col("model"))).alias("alias"), "model", "provider")).alias("best")).select(*key, "best.provider", "best.model")


def exact_models(texts: DataFrame, models: DataFrame) -> DataFrame:
    """(text, provider, model) of texts that are ``provider/model`` or, if that is nobody's, a model id; of one model only."""
    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    whole = clean(F.lower("text"))
    provider, model = clean(F.substring_index(whole, "/", 1)), clean(F.regexp_replace(whole, "^[^/]*/", ""))
    asked = texts.select("text", whole.alias("whole"), F.when(whole.contains("/") & (provider != "") & (model != ""), F.concat(provider, F.lit("/"), model)).alias("parts"))
    only = lambda c, n: models.groupBy(F.col(c).alias(n)).agg(F.count("*").alias(f"{n}_n"), F.first(F.struct("provider", "model")).alias(f"{n}_m"))
    out = asked.join(only("full", "whole"), "whole", "left").join(only("full", "parts"), "parts", "left").join(only("id", "bare"), F.col("whole") == F.col("bare"), "left")
    one = lambda n: F.when(F.col(f"{n}_n") == 1, F.col(f"{n}_m"))
    found = F.when(F.col("whole_n") >= 1, one("whole")).when(F.col("parts_n") >= 1, one("parts")).otherwise(one("bare"))
    return out.filter("whole != ''").select("text", found.alias("m")).filter("m IS NOT NULL").select("text", "m.provider", "m.model")


def short_models(asked: DataFrame, models: DataFrame) -> DataFrame:
    """(text, provider, model) of texts of up to three letters: these are runs themselves, whose preferred models are worked out once for each."""
    few = written(asked.filter(F.length("low") <= 3), "model-short-texts")
    found = grams_of(models, (1, 2, 3)).join(few.select(F.col("low").alias("gram")).distinct(), "gram").join(models, "no").filter((F.col("kind") == "name") | (F.col("pos") >= F.col("id_at")))
    best = best_of(found.select("gram", "provider", "model").unionByName(models.select(F.lit("").alias("gram"), "provider", "model")), "gram")
    return few.join(best, F.col("low") == F.col("gram")).select("text", "provider", "model")


def rare_runs(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(text, low, gram, offset): the run by which a text of more than three letters is looked up, about its rarest three; none if the models lack those."""
    offsets = asked.filter("length(low) > 3").withColumn("offset", F.explode(F.sequence(F.lit(0), F.length("low") - 3)))
    offsets = offsets.withColumn("gram", F.substring(F.col("low"), F.col("offset") + 1, F.lit(3))).join(counts, "gram", "left")
    rarest = offsets.groupBy("text", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "offset")).alias("r")).filter("r.n > 0").select("text", "low", F.col("r.offset").alias("at"))
    gram, offset = widened("low", "at")
    return rarest.select("text", "low", gram.alias("gram"), offset.alias("offset"))


def long_models(rare: DataFrame, models: DataFrame, postings: DataFrame) -> DataFrame:
    """(text, provider, model): of the models whose id or name holds the text, the preferred one. A posting tells where the text would begin, and is compared there."""
    begin = F.col("pos") - F.col("offset")
    there = F.substring(F.when(F.col("kind") == "full", F.col("full")).otherwise(F.col("name")), begin, F.length("low")) == F.col("low")
    found = rare.join(postings, "gram").join(models, "no").filter((begin >= F.when(F.col("kind") == "full", F.col("id_at")).otherwise(1)) & there)
    return best_of(found, "text")


def glob_runs(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """Globs with the ``pattern`` they mean and the run, ``gram``, by which they are looked up; ``*`` and ``?`` don't cross a slash, ``**`` does.

    The run is taken about the rarest three letters between wildcards and sets. A glob without any letter has an empty one, which all models have.
    """
    escaped = F.regexp_replace("text", r"([.+(){}^$|\\])", r"\\$1")
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"\[!", "[^"), r"\*\*", "\u0001"), r"\*", "[^/]*"), r"\?", "[^/]"), "\u0001", ".*")
    open_ = asked.withColumn("pattern", F.concat(F.lit("^"), pattern, F.lit("$")))
    plain = F.filter(F.split(F.regexp_replace("text", r"\[[^\]]*\]?", "*"), r"[*?]+"), lambda x: x != "")
    # three letters, else all of a piece
    run = lambda x, k: F.struct(F.substring(x, k + 1, F.lit(3)).alias("gram"), k.alias("at"), x.alias("piece"))
    runs = F.flatten(F.transform(plain, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(x) - 3)), lambda k: run(x, k))))
    wanted = open_.select("ref", F.explode(runs).alias("r")).select("ref", "r.*").join(counts, "gram", "left")
    rarest = wanted.groupBy("ref").agg(F.min(F.struct(F.coalesce("n_full", F.lit(0)).alias("n"), "gram", "at", "piece")).alias("g")).select("ref", "g.at", "g.piece")
    return open_.join(rarest.select("ref", widened("piece", "at")[0].alias("gram")), "ref", "left").withColumn("gram", F.coalesce("gram", F.lit("")))


def glob_models(keyed: DataFrame, models: DataFrame, postings: DataFrame) -> DataFrame:
    """(ref, provider, model): all models whose ``provider/model`` or id matches a glob."""
    places = postings.filter("kind = 'full'").select("gram", "no").distinct().unionByName(models.select(F.lit("").alias("gram"), "no"))
    met = keyed.join(places, "gram").join(models, "no").filter(F.rlike(F.col("full"), F.col("pattern")) | F.rlike(F.col("id"), F.col("pattern")))
    return met.select("ref", "provider", "model").distinct()


def postings_of(models: DataFrame, *askers: DataFrame) -> DataFrame:
    """Postings of the runs that are asked for."""
    wanted = None
    for x in askers:
        wanted = x.select("gram") if wanted is None else wanted.unionByName(x.select("gram"))
    wanted = written(wanted.filter("gram != ''").distinct(), "model-grams-wanted")
    lengths = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())  # at most seven numbers
    return written(grams_of(models, lengths or [1]).join(wanted, "gram"), "model-postings")


def resolve_model_refs(refs: DataFrame, catalog: DataFrame, ref: str = "ref") -> DataFrame:
    """Models that free-text references mean: (ref, provider, model, level, how, unknown_level). Unmatched references have null models.

    A glob keeps all models that it matches, a valid ``:level`` at its end split off first. Any other text is tried whole, then without
    its last ``:part``, and so on, until it matches: ``exact``, ``provider/model`` or an id that one model has, else ``contains``, the preferred model whose id or
    name (the catalog's ``name``, if it has one) holds it. ``level`` is the last part, if all parts taken off are levels; ``unknown_level``: one isn't.
    Matching is in any case; ids are compared by their bytes. Null references are left out. All joins are equi-joins.
    """
    name = F.lower("name") if "name" in catalog.columns else F.lit("")
    models = catalog.filter("provider IS NOT NULL AND model IS NOT NULL").select("provider", "model", F.lower(F.concat_ws("/", "provider", "model")).alias("full"), F.lower("model").alias("id"), (F.length("provider") + 2).alias("id_at"), F.coalesce(name, F.lit("")).alias("name")).distinct()
    models = written(models.withColumn("no", F.monotonically_increasing_id()), "models")
    counts = gram_counts(models)
    asked = written(refs.filter(F.col(ref).isNotNull()).select(F.col(ref).alias("ref")).distinct(), "model-refs")
    glob = F.col("ref").rlike(r"[*?\[]")
    level = F.regexp_extract("ref", ":(" + "|".join(LEVELS) + ")$", 1)
    globs = asked.filter(glob).select("ref", F.when(level != "", level).alias("level"), F.lower(F.when(level != "", F.regexp_replace("ref", ":[a-z]+$", "")).otherwise(F.col("ref"))).alias("text"))
    globs = written(glob_runs(globs, counts), "model-globs")

    parts = F.split("ref", ":", -1)
    tries = asked.filter(~glob).select("ref", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("off"))
    off = F.slice("parts", F.size("parts") - F.col("off") + 1, F.col("off"))
    known = F.forall(off, lambda x: x.isin(*LEVELS))
    tries = tries.select("ref", "off", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("off")), ":").alias("text"), F.when((F.col("off") > 0) & known, F.element_at("parts", -1)).alias("level"), (~known).alias("unknown_level"))
    tries = written(tries, "model-tries")
    texts = tries.select("text").distinct()
    exact = written(exact_models(texts, models), "model-exact")
    rest = texts.join(exact, "text", "left_anti").select("text", F.lower("text").alias("low"))
    rare = written(rare_runs(rest, counts), "model-rare-runs")
    postings = postings_of(models, rare, globs)
    many = globs.select("ref", "level").join(glob_models(globs, models, postings), "ref").withColumns({"how": F.lit("glob"), "unknown_level": F.lit(False)})
    partial = short_models(rest, models).unionByName(long_models(rare, models, postings))
    found = exact.withColumn("how", F.lit("exact")).unionByName(partial.withColumn("how", F.lit("contains")))
    single = tries.join(found, "text").groupBy("ref").agg(F.min_by(F.struct("level", "provider", "model", "how", "unknown_level"), "off").alias("m")).select("ref", "m.*")
    hits = many.unionByName(single)
    lost = asked.join(hits.select("ref"), "ref", "left_anti").withColumn("level", F.when(glob & (level != ""), level))
    none = F.lit(None).cast("string")
    return hits.unionByName(lost.withColumns({"provider": none, "model": none, "how": F.lit("none"), "unknown_level": F.lit(False)}))


def validate_catalog(models: DataFrame, providers: DataFrame, required: Sequence[str] = (), least: int = 500) -> DataFrame:
    """Violations as (rule, provider, detail): providers without models, models without a provider, required providers missing,
    repeated keys, too few models."""
    have = models.select("provider").distinct()
    rows = [
        providers.select("provider").distinct().join(have, "provider", "left_anti").select(F.lit("provider_without_models").alias("rule"), "provider", F.lit("").alias("detail")),
        have.join(providers, "provider", "left_anti").select(F.lit("unlisted_provider").alias("rule"), "provider", F.lit("").alias("detail")),
        models.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated_key").alias("rule"), "provider", F.col("model").alias("detail")),
        models.agg(F.count("*").alias("n")).filter(F.col("n") < least).select(F.lit("too_few_models").alias("rule"), F.lit(None).cast("string").alias("provider"), F.col("n").cast("string").alias("detail")),
    ]
    if required:
        wanted = models.sparkSession.createDataFrame([(p,) for p in required], "provider string")
        rows.append(wanted.join(have, "provider", "left_anti").select(F.lit("required_provider_missing").alias("rule"), "provider", F.lit("").alias("detail")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def catalog_revision(models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: models, and a hash of the content that doesn't depend on the order of rows."""
    line = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    return models.agg(F.count("*").alias("models"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(part).cast("string")), 256).alias("revision"))


def compile_glob(glob: str) -> Column:
    """Models whose provider/model matches a glob, in any case."""
    return F.lower(F.concat_ws("/", "provider", "model")).rlike("^" + ".*".join(re.escape(p) for p in glob.lower().split("*")) + "$")
