"""Benchmark decontamination with DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words before case is folded; words are runs of 0-9, A-Z, a-z and anything past ASCII.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order, case kept; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def folded(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """(item_id, size, gram, h): each distinct window of ``n`` consecutive words of each item, and its hash.

    An item of fewer words, but not of none, is one window of its own size.
    """
    return (
        benchmark.select(F.col(id_col).alias("item_id"), words(folded(F.col(text_col))).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.least(F.size("w"), F.lit(n)).alias("size"), "w")
        .select("item_id", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> array_join(slice(w, i, size), ' '))")).alias("gram"))
        .distinct()
        .withColumn("h", F.xxhash64(F.transform(F.split("gram", " "), lambda x: F.xxhash64(F.lower(x)))))
    )


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once; a plain reference would be copied into each lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def candidates(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __n_words and __found: (first, last, h, gram) of the windows whose hash may be in the set.

    The set of the benchmark's window hashes goes to all tasks as a bitmap of bounded size, as the value of a
    scalar subquery, however many windows there are. Each document is scanned in its own row. What
    passes is verified later by the window's own text, so that neither a hash nor full case folding decides.
    """
    bits, longs = common.bitmap(windows.select("h"))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most n

    def of_size(b: Column, w: Column, hw: Column, size: int) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (size - 1))
        window = lambda i: F.struct(i.alias("first"), (i + (size - 1)).alias("last"), F.xxhash64(F.slice(hw, i, F.lit(size))).alias("h"))
        hits = F.filter(F.transform(at, window), lambda x: common.may_hold(b, x["h"], longs))
        named = F.transform(hits, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["h"].alias("h"), folded(F.array_join(F.slice(w, x["first"], F.lit(size)), " ")).alias("gram")))
        return F.when(F.size(w) >= size, named).otherwise(F.array().cast("array<struct<first:int,last:int,h:bigint,gram:string>>"))

    def scanned(b: Column, w: Column, hw: Column) -> Column:
        parts = [of_size(b, w, hw, size) for size in sizes]
        found = F.concat(*parts) if parts else F.array().cast("array<struct<first:int,last:int,h:bigint,gram:string>>")
        return F.struct(F.size(w).alias("n_words"), found.alias("found"))

    # each value is bound once: a reference would be copied into the lambdas, and a subquery may not stand in one
    scan = _let(F.col("__bits"), lambda b: _let(words(F.col(text_col)), lambda w: _let(F.transform(w, lambda x: F.xxhash64(F.lower(x))), lambda hw: scanned(b, w, hw))))
    out = docs.withColumn("__bits", bits.scalar()).withColumn("__scan", scan).drop("__bits")
    return out.withColumns({"__n_words": F.col("__scan.n_words"), "__found": F.col("__scan.found")}).drop("__scan")


def verified(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(__key, spans, grams): the windows that do occur in each text; from (__key, __found) of texts with candidates.

    Copies of a text are looked at once. The join is by hash and window text; its other side has a row a window, so
    a passage that a third of the texts hold can be split.
    """
    texts = found.groupBy("__key").agg(F.first("__found").alias("f"))
    hits = texts.select("__key", F.explode("f").alias("x")).select("__key", "x.*")
    known = windows.select(F.col("h").alias("__h"), F.col("gram").alias("__gram")).distinct()
    return (
        hits.join(known, (F.col("h") == F.col("__h")) & (F.col("gram") == F.col("__gram"))).groupBy("__key")
        .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set(F.xxhash64("gram"))).alias("grams"))
    )


def _key(text_col: str) -> Column:
    """What stands for a text: copies share it, and so do their results."""
    return F.sha2(F.col(text_col), 256)


def n_hit(spans: str = "spans") -> Column:
    """Words inside any span; spans come in order of their first word."""
    return F.expr(
        f"aggregate({spans}, struct(0L as n, 0 as upto), (a, s) -> struct(a.n + greatest(0, s.last - greatest(a.upto, s.first - 1)) as n, "
        "greatest(a.upto, s.last) as upto), a -> a.n)"
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; repeated rows are reported as often as they occur; an empty
    benchmark contaminates nothing; other columns, whatever their names, are left out. Items are looked up once
    for each distinct set of windows found, so a passage that a third of the documents share is joined once.
    """
    windows, _ = common.written(item_windows(benchmark, text_col="text", n=n), "windows")
    narrow = candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), windows)
    narrow = narrow.select("doc_id", F.col("__n_words").cast("long").alias("n_words"), F.when(F.size("__found") > 0, _key("text")).alias("__key"), "__found")
    scanned, _ = common.written(narrow, "scan")
    hits, _ = common.written(verified(scanned.where("__key is not null").select("__key", "__found"), windows), "hits")
    named = hits.withColumn("set", F.sha2(F.array_join("grams", ",").cast("binary"), 256))
    by_item = windows.select(F.xxhash64("gram").alias("gram"), F.col("item_id").cast("string").alias("item"))
    sets = named.groupBy("set").agg(F.first("grams").alias("grams"))
    items = sets.select("set", F.explode("grams").alias("gram")).join(by_item, "gram").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    digests = items.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    facts = named.join(digests, "set", "left").select(F.col("__key").alias("__hit"), n_hit().alias("n_hit"), "n_items", "items_sha256")
    some = scanned.where("__key is not null").join(facts, F.col("__key") == F.col("__hit"), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    some = some.select("doc_id", "n_words", *[F.coalesce(c, d).alias(c) for c, d in (("n_hit", F.lit(0).cast("long")), ("n_items", F.lit(0).cast("long")), ("items_sha256", nothing))])
    clean = scanned.where("__key is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items_sha256"))
    return some.unionByName(clean).withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("doc_id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without benchmark passages.

    ``remove="documents"`` drops each document in which a window occurs; ``remove="spans"`` keeps it
    and cuts the words of the occurrences out, with the separator before each of them. Documents that no
    found key concerns pass in their own row; only the others are shuffled, by the digest of their text.
    Null and empty texts stay; repeated rows are treated alike; all columns are kept.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is {remove!r}; use 'documents' or 'spans'")
    columns = docs.columns
    windows, _ = common.written(item_windows(benchmark, n=n), "windows")
    some = candidates(docs.select(F.col(text_col).alias("text")), windows).where(F.size("__found") > 0).select(_key("text").alias("__key"), "__found")
    scanned, _ = common.written(some, "scan")
    hits, _ = common.written(verified(scanned, windows).select(F.col("__key").alias("__hit"), F.col("spans").alias("__spans")), "hits")
    clean, maybe = common.parted(docs, _key(text_col), hits.select("__hit"))
    joined = lambda how: maybe.join(common.shuffled(hits), F.col("__key") == F.col("__hit"), how)
    if remove == "documents":
        return clean.unionByName(joined("left_anti").select(*columns))
    pieces = F.split(F.col(text_col), r"(?<=[0-9A-Za-z\u0080-\x{10FFFF}])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])|(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[0-9A-Za-z\u0080-\x{10FFFF}])")
    offset = F.when(F.get(F.col("__pieces"), F.lit(0)).rlike(r"^[0-9A-Za-z\u0080-\x{10FFFF}]"), 3).otherwise(2)
    cut = F.expr("array_join(filter(__pieces, (p, j) -> not exists(__spans, s -> (j + __offset) div 2 between s.first and s.last)), '')")
    text = F.when(F.col("__spans").isNotNull(), cut).otherwise(F.col(text_col))
    return clean.unionByName(joined("left").withColumn("__pieces", F.when(F.col("__spans").isNotNull(), pieces)).withColumn("__offset", offset).withColumn(text_col, text).select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    """The report on the whole of ``documents`` against the whole of ``benchmark``."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS size, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM bw),
sizes AS (SELECT DISTINCT size FROM grams),
dw AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
occ AS (SELECT doc_id, i, x.size, item_id FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM dw) x JOIN grams g ON g.gram = x.gram AND g.size = x.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
