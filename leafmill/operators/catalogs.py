"""Catalogues of voices and models: unions, lookups, defaults, missing entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill import constants as C

# What the letters of a coded voice id mean (language, locale), and its default voices.
CODED_LANGUAGES = {
    "a": ("en", "en-US"), "b": ("en", "en-GB"), "e": ("es", "es-ES"), "f": ("fr", "fr-FR"), "h": ("hi", "hi-IN"), "i": ("it", "it-IT"), "p": ("pt", "pt-BR"),
}
CODED_DEFAULTS = {"en": "af_heart", "es": "ef_dora", "fr": "ff_siwis", "hi": "hf_alpha", "it": "if_sara", "pt": "pf_dora"}
#: Host and namespace of a model name without them.
DEFAULT_HOST, DEFAULT_NAMESPACE, DEFAULT_TAG = "registry.ollama.ai", "library", "latest"
ENGINES = ("piper", "edge", "macos", "kokoro")


def text_map(entries: dict[str, str]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def coded_voices(ids: DataFrame) -> DataFrame:
    """[S14] Voices from ids whose first letter is a language and whose second a gender."""
    language = text_map({k: v[0] for k, v in CODED_LANGUAGES.items()})
    locale = text_map({k: v[1] for k, v in CODED_LANGUAGES.items()})
    first = F.substring("id", 1, 1)
    gender = F.when(F.substring("id", 2, 1) == "f", "female").otherwise("male")
    name = F.initcap(F.replace(F.substring("id", 4, 100), F.lit("_"), F.lit(" ")))
    return ids.select("id", name.alias("name"), F.try_element_at(language, first).alias("language"), F.try_element_at(locale, first).alias("locale"), gender.alias("gender"))


def listed_voices(lines: DataFrame) -> DataFrame:
    """[S14] Voices from the lines of a command: name, locale, ``#`` and a sample."""
    pattern = r"^(.+?)\s+([a-z]{2,3}_[A-Z0-9]{2,3})\s+#"
    rows = lines.where(F.col("line").rlike(pattern)).select(F.trim(F.regexp_extract("line", pattern, 1)).alias("name"), F.replace(F.regexp_extract("line", pattern, 2), F.lit("_"), F.lit("-")).alias("locale"))
    return rows.select(F.col("name").alias("id"), "name", F.substring_index("locale", "-", 1).alias("language"), "locale")


def installed_and_catalogued(catalogue: DataFrame, installed: DataFrame) -> DataFrame:
    """[J10, U2] All voices, catalogued or installed: what the catalogue lacks comes from the id's parts.

    ``catalogue``: (id, name, quality, code, family, size_bytes); ``installed``: (id).
    """
    have = installed.select("id").distinct().withColumn("here", F.lit(True))
    rows = catalogue.join(have, "id", "full_outer")
    code = F.coalesce(F.nullif("code", F.lit("")), F.split("id", "-")[0])
    name = F.when(F.contains(F.col("id"), F.lit("-")), F.coalesce(F.nullif("name", F.lit("")), F.get(F.split("id", "-"), F.lit(1)))).otherwise(F.col("id"))
    label = F.concat(name, F.when(F.coalesce("quality", F.lit("")) != "", F.concat(F.lit(" · "), "quality")).otherwise(""))
    note = F.when(F.col("here"), "downloaded").when(F.coalesce("size_bytes", F.lit(0)) > 0, F.format_string("%.0f MB download", F.col("size_bytes") / 1e6)).otherwise("")
    language = F.coalesce(F.nullif("family", F.lit("")), F.split(code, "_")[0])
    return rows.select("id", label.alias("name"), language.alias("language"), F.replace(code, F.lit("_"), F.lit("-")).alias("locale"), note.alias("note"))


def default_voices(wanted: DataFrame, catalogue: DataFrame, preferred: DataFrame, fallback: str) -> DataFrame:
    """[A10, A11] (language, voice): the preferred one if it exists, else the best of the language, else the fallback.

    Best is by rank of quality, then one speaker, then the largest id.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in C.QUALITY_RANK.items() for x in p]), F.coalesce("quality", F.lit(""))), F.lit(0))
    single = F.coalesce("num_speakers", F.lit(1)) == 1
    best = catalogue.groupBy(F.col("family").alias("language")).agg(F.max_by("id", F.struct(rank.alias("r"), single.alias("s"), F.col("id"))).alias("best"))
    known = preferred.join(catalogue.select("id").distinct(), "id", "left_semi").select("language", F.col("id").alias("first"))
    return wanted.join(known, "language", "left").join(best, "language", "left").select("language", F.coalesce("first", "best", F.lit(fallback)).alias("voice"))


def marked_default(wanted: DataFrame, voices: DataFrame, fallback: str = "Samantha") -> DataFrame:
    """[A11] The first enhanced voice of the language (or of English), else its first voice, else the fallback."""
    marked = F.when(F.col("name").rlike(r"\((Enhanced|Premium)\)"), 0).otherwise(1)
    best = voices.groupBy("language").agg(F.min_by("id", F.struct(marked.alias("m"), F.col("locale"), F.col("name"))).alias("best"))
    english = best.select(F.col("language").alias("__en"), F.col("best").alias("english"))
    keyed = wanted.withColumn("__en", F.lit("en")).join(best, "language", "left").join(english, "__en", "left")
    return keyed.select("language", F.coalesce("best", "english", F.lit(fallback)).alias("voice"))


def voices_for(voices: DataFrame, language: str, current: str | None = None) -> DataFrame:
    """[F14, O1] Voices of a language, or all where it has none; the current one first, then by locale and name."""
    own = voices.withColumn("__any", F.max((F.col("language") == language).cast("int")).over(Window.partitionBy(F.lit(1))))
    kept = own.where((F.col("__any") == 0) | (F.col("language") == language) | (F.col("id") == F.lit(current))).drop("__any")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.coalesce(F.col("id") == F.lit(current), F.lit(False))), "locale", "name")))


def engine_for(engine: Column, language: Column, voice: Column) -> Column:
    """[D2] The engine to use: one without the language and without a chosen voice gives way; unknown names raise."""
    lacks = (engine == "kokoro") & ~language.isin(*CODED_DEFAULTS) & (F.coalesce(voice, F.lit("")) == "")
    unknown = F.raise_error(F.concat(F.lit("unknown engine: "), engine)).cast("string")
    return F.when(lacks, "piper").when(engine.isin(*ENGINES), engine).otherwise(unknown)


def voice_label(name: Column, locale: Column, gender: Column) -> Column:
    """[X27] Name, locale and what is known besides."""
    return F.concat(name, F.lit(" ("), locale, F.when(F.coalesce(gender, F.lit("")) != "", F.concat(F.lit(", "), gender)).otherwise(""), F.lit(")"))


def model_ref(text: Column) -> Column:
    """[X18] host, namespace, name and tag of a model name; raises for an empty one."""
    t = F.trim(text)
    last = F.element_at(F.split(t, "/"), -1)
    tagged = F.contains(last, F.lit(":"))
    tag = F.when(tagged & ~t.endswith(":"), F.element_at(F.split(t, ":"), -1)).otherwise(DEFAULT_TAG)
    name = F.when(tagged, F.regexp_replace(t, r":[^:]*$", "")).otherwise(t)
    parts = F.split(name, "/")
    host = F.when(F.size(parts) >= 3, parts[0]).otherwise(DEFAULT_HOST)
    space = F.when(F.size(parts) == 1, DEFAULT_NAMESPACE).when(F.size(parts) == 2, parts[0]).otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 2)), "/"))
    found = F.struct(host.alias("host"), space.alias("namespace"), F.element_at(parts, -1).alias("name"), tag.alias("tag"))
    return F.when(t == "", F.raise_error(F.lit("no model name given")).cast("struct<host:string,namespace:string,name:string,tag:string>")).otherwise(found)


def model_display(ref: Column) -> Column:
    """[X18] The shortest name that means the same."""
    own = ref["host"] == DEFAULT_HOST
    base = F.when(own & (ref["namespace"] == DEFAULT_NAMESPACE), ref["name"]).when(own, F.concat_ws("/", ref["namespace"], ref["name"])).otherwise(F.concat_ws("/", ref["host"], ref["namespace"], ref["name"]))
    return F.concat(base, F.lit(":"), ref["tag"])


def local_models(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """[J8, U3, S15, O2] (name, store, digest, size): models whose weights are there, the first store winning.

    ``manifests``: (store, priority, name, digest, size), size null if not stated; ``blobs``: (store, digest, bytes).
    """
    found = manifests.join(blobs, ["store", "digest"]).where("bytes = coalesce(size, bytes)")
    first = Window.partitionBy("name").orderBy("priority")
    return found.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("name", "store", "digest", F.col("bytes").alias("size"))


def missing_models(recommended: DataFrame, local: DataFrame) -> DataFrame:
    """[J9, U4] Recommended models that are not there."""
    return recommended.join(local.select("name"), "name", "left_anti")


def download_sizes(registry: DataFrame, present: DataFrame) -> DataFrame:
    """[A13, H3, H4] (model, total, missing) bytes of registered files; a file of another size is missing."""
    here = present.select("path", F.col("size").alias("have"))
    rows = registry.join(here, "path", "left")
    lacks = ~(F.coalesce("have", F.lit(-1)) == F.col("size"))
    return rows.groupBy("model").agg(F.sum("size").alias("total"), F.coalesce(F.sum(F.when(lacks, F.col("size"))), F.lit(0)).alias("missing"))
