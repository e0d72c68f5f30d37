"""URL filters: a tree of path templates for each host, judged by smoothed purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common

#: (host, path prefix, verdict). A rule fits its host and its subdomains; the longest wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls that a branch needs on both sides to be compared by a two-proportion z, the z from which branches differ,
#: the difference of smoothed shares from which branches differ that are too small for that, prior weight, and the purity that rejects.
LEAST, ALIKE, APART, PRIOR, REJECT = 5, 1.96, 0.5, 2.0, 0.5
#: Labels a domain name may have at most (RFC 1035); longer hosts have no parent domains.
LABELS = 127


def host(url: Column) -> Column:
    r"""After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdicts(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``urls`` (with host and path) with rule (host and prefix of the longest that fits) and rule_verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, says in reversed(ordered):
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(prefix)
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return urls.withColumn("rule", name).withColumn("rule_verdict", verdict)


def segments(path_col: str = "path") -> Column:
    """All segments of a path; what carries digits is variable at once: ``*``, an ending kept."""
    raw = F.array_remove(F.split(F.col(path_col), "/"), "")
    return F.transform(raw, lambda s: F.when(s.rlike(r"[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def domains(host_col: str = "host") -> Column:
    """All hosts (the empty name), then the domains above a host from the top down, without the host itself."""
    parts = F.split(F.col(host_col), "[.]")
    above = F.expr(f"transform(sequence(1, size(split({host_col}, '[.]')) - 1), i -> substring_index({host_col}, '.', -i))")
    return F.concat(F.array(F.lit("")), F.when((F.size(parts) > 1) & (F.size(parts) <= LABELS), above).otherwise(F.array().cast("array<string>")))


def _differ(p: Column, m: Column, q: Column, n: Column, alike: float) -> Column:
    """Two-proportion z of shares p of m and q of n reaches ``alike``."""
    pooled = (p * m + q * n) / (m + n)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n))
    return (spread > 0) & (F.abs(p - q) >= alike * spread)


def _expected(counts: DataFrame, prior: float) -> DataFrame:
    """(host, raw, prior_share): the blocked share to be expected of a raw template of a host from what other hosts show.

    Shares back off from domain to domain: all urls, the template on all hosts, on the top domain, and so on
    down to the domain above the host; each level has weight ``prior`` in the next.
    """
    base = counts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("base")).first()["base"] or 0.0
    shown = counts.where("m > 0").select(F.explode(domains()).alias("domain"), "raw", "k", "m").groupBy("domain", "raw").agg(F.sum("k").alias("k"), F.sum("m").alias("m"))
    asked = counts.select("host", "raw", F.posexplode(domains()).alias("level", "domain"))
    found = asked.join(shown, ["domain", "raw"]).groupBy("host", "raw").agg(F.array_sort(F.collect_list(F.struct("level", "k", "m"))).alias("levels"))
    share = F.aggregate("levels", F.lit(float(base)), lambda p, x: (x["k"] + prior * p) / (x["m"] + prior))
    return counts.join(found, ["host", "raw"], "left").withColumn("prior_share", F.coalesce(share, F.lit(float(base)))).drop("levels")


def _merged(rows: DataFrame, least: int, alike: float, apart: float, prior: float) -> DataFrame:
    """``rows`` of branching nodes, each moved one branching down: its segment there kept or made ``*``, its level behind it.

    A child merges into ``*`` unless it differs from all its sisters together: by a two-proportion z of the
    blocked shares or of the shares of urls that end at the child, where both sides have ``least`` urls; else by
    smoothed shares that lie ``apart``. Smoothed shares hold what other hosts show, so branches without labels
    join those they resemble.
    """
    child = F.get("segs", F.col("fork"))
    parts = rows.withColumns({"node": F.slice("segs", F.lit(1), F.col("fork")), "child": child})
    sums = lambda *more: [F.sum(c).alias(f"c_{c}") for c in ("n", "k", "m", "expected", "ends", *more)]
    children = (
        parts.where("child is not null")
        .withColumns({"expected": F.col("n") * F.col("prior_share"), "ends": F.when(F.size("segs") == F.col("fork") + 1, F.col("n")).otherwise(0)})
        .groupBy("host", "node", "child").agg(*sums())
    )
    totals = children.groupBy("host", "node").agg(*[F.sum(f"c_{c}").alias(f"t_{c}") for c in ("n", "k", "m", "expected", "ends")], F.count("*").alias("kinds"))
    both = children.join(totals, ["host", "node"])
    rest = {c: F.col(f"t_{c}") - F.col(f"c_{c}") for c in ("n", "k", "m", "expected", "ends")}
    own = {c: F.col(f"c_{c}") for c in rest}
    smooth = lambda x: (x["k"] + prior * x["expected"] / x["n"]) / (x["m"] + prior)
    known = (own["m"] >= least) & (rest["m"] >= least)
    by_label = F.when(known, _differ(own["k"] / own["m"], own["m"], rest["k"] / rest["m"], rest["m"], alike)).otherwise(F.abs(smooth(own) - smooth(rest)) >= apart)
    seen = (own["n"] >= least) & (rest["n"] >= least)
    by_shape = F.when(seen, _differ(own["ends"] / own["n"], own["n"], rest["ends"] / rest["n"], rest["n"], alike)).otherwise(False)
    moves = both.where((F.col("kinds") > 1) & ~by_label & ~by_shape & (F.col("child") != "*")).select(F.col("host").alias("__host"), F.col("node").alias("__node"), F.col("child").alias("__child"))
    joined = parts.join(moves, (F.col("host") == F.col("__host")) & (F.col("node") == F.col("__node")) & (F.col("child") == F.col("__child")), "left")
    segs = F.when(F.col("__child").isNotNull(), F.concat("node", F.array(F.lit("*")), F.expr("slice(segs, fork + 2, size(segs))"))).otherwise(F.col("segs"))
    return joined.select("host", "raw", "n", "k", "m", "prior_share", segs.alias("segs"), (F.col("fork") + 1).alias("level"))


def templates(urls: DataFrame, least: int = LEAST, alike: float = ALIKE, apart: float = APART, prior: float = PRIOR) -> DataFrame:
    """(host, segs, template, purity): what each raw path of a host generalises to, and how blocked it is.

    ``urls``: host, path and label (``block``, ``allow`` or null). Urls are counted by host and raw
    template before anything is joined, so a host with a third of all pages is a few rows. The trees of
    all hosts grow together, a round a branching: a node's common prefix is passed at once (that of its
    least and its greatest row), and rows that are alone below a node are finished, so the number of
    rounds is that of branchings on one path, however deep the paths are. Purity is
    (blocked + prior * expected) / (labelled + prior), with what :func:`_expected` says of the template's paths.
    """
    spark = urls.sparkSession
    counts = (
        urls.select("host", segments().alias("raw"), "label").groupBy("host", "raw")
        .agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == "block", 1)).alias("k"), F.count("label").alias("m"))
    )
    counts, _ = common.written(counts, "paths")
    rows, _ = common.written(_expected(counts, prior).select("host", "raw", "n", "k", "m", "prior_share", F.col("raw").alias("segs"), F.lit(0).alias("level")), "tree")
    finished = []
    same = F.expr("cast(array_position(zip_with(lo, hi, (a, b) -> a <=> b), false) as int) - 1")
    while not rows.isEmpty():
        nodes = rows.groupBy("host", F.slice("segs", F.lit(1), F.col("level")).alias("at"), "level").agg(F.min("segs").alias("lo"), F.max("segs").alias("hi"))
        nodes = nodes.select(F.col("host").alias("__host"), "at", F.col("level").alias("__level"), F.when(F.col("lo") != F.col("hi"), same).alias("fork"))
        on = (F.col("host") == F.col("__host")) & (F.slice("segs", F.lit(1), F.col("level")) == F.col("at")) & (F.col("level") == F.col("__level"))
        placed, _ = common.written(rows.join(nodes, on).drop("__host", "at", "__level"), "tree")
        finished.append(placed.where("fork is null").select("host", "raw", "segs", "n", "k", "m", "prior_share"))
        rows, _ = common.written(_merged(placed.where("fork is not null"), least, alike, apart, prior), "tree")
    if not finished:
        return spark.createDataFrame([], "host string, segs array<string>, template string, purity double")
    grown = finished[0]
    for part in finished[1:]:
        grown = grown.union(part)
    trees = grown.groupBy("host", "segs").agg(F.sum("k").alias("k"), F.sum("m").alias("m"), (F.sum(F.col("n") * F.col("prior_share")) / F.sum("n")).alias("expected"))
    scored = trees.select("host", "segs", ((F.col("k") + prior * F.col("expected")) / (F.col("m") + prior)).alias("purity"))
    return grown.join(scored, ["host", "segs"]).select("host", F.col("raw").alias("segs"), F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), "purity")


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, reject: float = REJECT, **options) -> DataFrame:
    """id, host, path, rule, template, purity and verdict of every row of ``pages``.

    What the rules say is the label from which the templates learn; a url without a rule gets
    ``block`` if its template's purity is at least ``reject``, else ``allow``. Rules of one length that
    both fit go by host. A null url or one without ``://`` has empty host and path and shares the template
    of that empty host. Repeated rows are judged alike; an empty table gives no rows; other columns,
    whatever their names, are left out.
    """
    urls = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    urls = rule_verdicts(urls, rules).withColumn("segs", segments())
    learned, _ = common.written(templates(urls.withColumnRenamed("rule_verdict", "label"), **options), "templates")
    verdict = F.coalesce("rule_verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return urls.join(learned, ["host", "segs"], "left").select("id", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict (and template, purity) of every page."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


#: Host, path and rule in DuckDB's SQL; the verdict of pages without a rule is learned and has none.
RULES_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}')" for h, p, _ in RULES)}) t(domain, prefix)),
fit AS (SELECT page_id, arg_max(domain || prefix, length(domain || prefix)) AS rule FROM u, r
        WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, host, path, rule FROM u LEFT JOIN fit USING (page_id)
"""
