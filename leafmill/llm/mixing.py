"""Mixing sources to target token counts by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leafmill.llm import common

#: Weights of the sources in order of their names, repeating; tokens to share, as a part of all; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Newton rounds at most, the most a multiplier changes in a round, the largest change after which they end (the error then is its square), and constraints that may meet.
ROUNDS, STEP, TOLERANCE, MEETING = 100, 1.0, 1e-9, 1000
#: Bits of a row's draw that one pass of the rounding looks at.
BITS = 10
#: The fractional part of its multiples spreads evenly, whatever rows are skipped.
GOLDEN = 0.6180339887498949


def size_of(text: Column) -> Column:
    r"""Number of runs without ASCII white space; 0 for null."""
    gaps = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(gaps, "")).cast("long")


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, total), a row each, with target: the tokens each should give.

    Weights repeat over the sources by code point, null last. A target stops at ``most`` times its source's
    total; what is over is shared again by weight among the others, until none is above. Sources are
    ranked by range partitions and the row's place in its own, and each round of sharing is one aggregation of
    which the driver sees four numbers, so there may be any number of sources.
    """
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    place = F.monotonically_increasing_id()
    placed, _ = common.written(ordered.select("source", "total", F.spark_partition_id().alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sources")
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = sources.sparkSession.createDataFrame(rows, "part int, before long")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked, _ = common.written(placed.join(offsets, "part").select("source", "total", F.get(table, F.expr(f"cast((at + before) % {len(weights)} as int)")).alias("weight")), "sources")
    full = float(most) * F.col("total")
    scale, done = None, -1
    while True:
        above = F.lit(False) if scale is None else F.lit(scale) * F.col("weight") > full
        spent = ranked.agg(F.sum("total").alias("all"), F.sum(F.when(above, full)).alias("used"), F.sum(F.when(~above, F.col("weight"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        rest, weight = share * (spent["all"] or 0) - (spent["used"] or 0.0), spent["w"] or 0.0
        if spent["n"] == done:
            break
        done, scale = spent["n"], rest / weight if weight else math.inf
    return ranked.select("source", "total", F.when(above, full).otherwise(F.lit(rest) * F.col("weight") / F.lit(weight or 1.0)).alias("target"))


def multipliers(cells: DataFrame, goals: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(name, multiplier) of each constraint of ``goals`` (name, goal), by Newton rounds on the dual that are one aggregation each.

    ``cells``: (names array<string>, tokens), the tokens of all documents that fall under the same constraints. The dual is
    the sum of tokens * exp(multipliers of the cell) less goal * multiplier; its gradient and Hessian are sums over the
    cells. Where each cell is under one constraint, as with sources, the Hessian is diagonal: the multipliers are a
    table that each round joins, sums up and writes again, of any number of rows, and the driver sees the largest step. Constraints that
    meet in a cell, at most ``MEETING`` of them, have a full Hessian, which the driver solves (see :func:`balance`).
    """
    spark = cells.sparkSession
    cells, _ = common.written(cells.select("names", F.col("tokens").cast("double").alias("tokens")), "cells")
    if cells.where(F.size("names") > 1).limit(1).count():
        named = [(r.name, r.goal) for r in goals.orderBy("name").limit(MEETING + 1).collect()]
        if len(named) > MEETING:
            raise ValueError(f"more than {MEETING} constraints that meet")
        at = F.create_map(*[F.lit(x) for k, (n, _) in enumerate(named) for x in (n, k)])
        found = balance(cells.select(F.transform("names", lambda n: at[n]).alias("idx"), "tokens").groupBy("idx").agg(F.sum("tokens").alias("tokens")), [g for _, g in named])
        return spark.createDataFrame([(n, float(m)) for (n, _), m in zip(named, found, strict=True)], "name string, multiplier double")
    mine = cells.select(F.get("names", F.lit(0)).alias("name"), "tokens")
    state, path = common.written(goals.select(F.col("name").alias("__name"), F.col("goal").cast("double").alias("goal"), F.lit(0.0).alias("multiplier")), "multipliers")
    for _ in range(rounds):
        tilted = mine.join(state, F.col("name").eqNullSafe(F.col("__name"))).groupBy("__name", "goal", "multiplier").agg(F.sum(F.col("tokens") * F.exp("multiplier")).alias("mass"))
        step = F.greatest(F.lit(-STEP), F.least(F.lit(STEP), F.when(F.col("mass") > 0, F.col("goal") / F.col("mass") - 1).otherwise(0.0)))
        seen = Observation()
        moved = tilted.withColumn("step", step).observe(seen, F.max(F.abs("step")).alias("most"))
        state, new_path = common.written(moved.select("__name", "goal", (F.col("multiplier") + F.col("step")).alias("multiplier")), "multipliers")
        common.remove(spark, path)
        path = new_path
        if (seen.get["most"] or 0.0) <= tolerance:
            break
    return state.select(F.col("__name").alias("name"), "multiplier")


def balance(cells: DataFrame, goals: list[float], rounds: int = 60, tolerance: float = 1e-10) -> np.ndarray:
    """Multipliers of the entropy-balancing problem, by Newton iterations on its convex dual.

    ``cells``: (idx array<int>, tokens double), the tokens of all documents that fall under the same
    constraints. Among document rates r the problem is to minimise the token-weighted relative
    entropy to 1 subject to sum(tokens * r) = goal for each constraint; the solution is the
    exponential tilt r = exp(sum of the multipliers of the document's constraints). The dual is
    sum(tokens * r) - goal . m; each round one aggregation over ``cells`` gives its value, gradient
    and Hessian, of which the driver sees a row for each pair of constraints that meet.
    """
    goal = np.array(goals, float)
    m = np.zeros(len(goal))
    if not len(goal):
        return m

    def dual(at: np.ndarray) -> tuple[float, np.ndarray, dict]:
        table = F.lit([float(x) for x in at])
        tilt = F.exp(F.aggregate("idx", F.lit(0.0), lambda a, i: a + F.get(table, i)))
        rows = (
            cells.withColumn("mass", F.col("tokens") * tilt)
            .select(F.explode("idx").alias("i"), "idx", "mass")
            .select("i", F.explode("idx").alias("j"), "mass", (F.element_at("idx", 1) == F.col("i")).alias("first"))
            .groupBy("i", "j").agg(F.sum("mass").alias("mass"), F.sum(F.when(F.col("first") & (F.col("i") == F.col("j")), F.col("mass"))).alias("once"))
            .collect()
        )
        pairs = {(r.i, r.j): r.mass for r in rows}
        sums = np.array([pairs.get((k, k), 0.0) for k in range(len(goal))])
        return sum(r.once or 0.0 for r in rows) - float(goal @ at), sums - goal, pairs

    value, gradient, pairs = dual(m)
    for _ in range(rounds):
        if np.all(np.abs(gradient) <= tolerance * np.maximum(goal, 1)):
            break
        step = _newton(pairs, gradient)
        scale = 1.0
        while True:
            new = dual(m + scale * step)
            if new[0] <= value + 1e-12 * abs(value) or scale < 1e-6:
                break
            scale /= 2
        m = m + scale * step
        value, gradient, pairs = new
    return m


def _newton(pairs: dict, gradient: np.ndarray) -> np.ndarray:
    if all(i == j for i, j in pairs):  # constraints that do not meet: a diagonal Hessian
        diagonal = np.array([pairs.get((k, k), 0.0) for k in range(len(gradient))])
        return np.divide(-gradient, diagonal, out=np.zeros_like(gradient), where=diagonal > 0)
    hessian = np.zeros((len(gradient),) * 2)
    for (i, j), mass in pairs.items():
        hessian[i, j] = mass
    return np.linalg.lstsq(hessian, -gradient, rcond=None)[0]


def draw(id_col: str, text_col: str, source_col: str) -> Column:
    """63 bits that order the documents of a source as if at random, alike in every run."""
    return F.shiftrightunsigned(common.hash_of(id_col, source_col, text_col), 1)


def _pivots(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, pivot, fraction, tied): of ``sources`` (source, extra) the draw up to which rows get one copy more.

    ``rows``: (source, size, draw). Rows below the pivot together have the ``extra`` tokens but for the rows at the pivot,
    which get ``fraction`` of their tokens. The draws are summed by their first bits; only the cell in which the sum is
    reached is looked at again with more bits. A pass gives at most 2**BITS small rows a source, however large it is.
    """
    found, _ = common.written(sources.where("extra > 0").select("source", F.col("extra").alias("need"), F.lit(0).cast("long").alias("cell")), "pivots")
    above, shift = 63, 63
    while True:
        above, shift = shift, max(0, shift - BITS)
        asked = found.select(F.col("source").alias("__source"), "need", F.col("cell").alias("__cell"))
        inside = rows.where("size > 0").join(asked, F.col("source").eqNullSafe(F.col("__source")) & (F.shiftrightunsigned("draw", above) == F.col("__cell")))
        cells = inside.groupBy("source", "need", F.shiftrightunsigned("draw", shift).alias("cell")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"), F.min("draw").alias("least"), F.max("draw").alias("last"))
        so_far = cells.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
        row = F.struct("cell", "need", "upto", "tokens", "n", "least", "last")
        reached = so_far.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), row)), F.max(row)).alias("r")).select("source", "r.*")
        found, _ = common.written(reached.select("source", (F.col("need") - F.col("upto") + F.col("tokens")).alias("need"), "cell", "tokens", "n", "least", "last"), "pivots")
        if shift == 0 or not found.where("least < last").limit(1).count():
            break
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("need") / F.col("tokens")))
    return found.select("source", F.col("least").alias("pivot"), F.when(F.col("n") > 1, part).otherwise(F.round(part)).alias("fraction"), (F.col("n") > 1).alias("tied"))


def cell_of(source_col: str, shares: dict | None) -> Column:
    """What names the cell of a document: its source, and with ``shares`` its values in those columns, as text."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in (source_col, *shares)])) if shares else F.col(source_col).cast("string")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, shares: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (id, source, cell, size, draw), one a document, and (cell, source_size, target, base, pivot, fraction, tied), one a cell.

    A cell is a source; with ``shares``, parts that the values of more columns should have of all tokens taken, it is a source
    and a value of each of these columns. Values that are not named there are free. Rates are the exponential tilt of the cell's constraints.
    """
    source = F.col(source_col).cast("string")
    more = list(shares or {})
    narrow, _ = common.written(docs.select(F.col(id_col).alias("id"), source.alias("source"), cell_of(source_col, shares).alias("cell"), *[F.col(c).cast("string").alias(f"__{c}") for c in more], size_of(F.col(text_col)).alias("size"), draw(id_col, text_col, source_col).alias("draw")), "sizes")
    sources = with_targets(narrow.groupBy("source").agg(F.sum("size").alias("total")), weights, share, most)
    name = F.concat(F.lit("source:"), F.coalesce(F.col("source"), F.lit(""))) if more else F.col("source")
    goals = sources.where("total > 0").select(F.when(F.col("source").isNull() & F.lit(bool(more)), "source").otherwise(name).alias("name"), F.col("target").alias("goal"))
    cells = narrow.groupBy("cell", "source", *[f"__{c}" for c in more]).agg(F.sum("size").alias("tokens"))
    names = F.array(F.when(F.col("source").isNull() & F.lit(bool(more)), "source").otherwise(name))
    if more:
        taken = sources.agg(F.sum("target")).first()[0] or 0.0
        rows = [(f"{c}:{v}", float(part) * taken) for c, parts in shares.items() for v, part in parts.items()]
        goals = goals.unionByName(docs.sparkSession.createDataFrame(rows, "name string, goal double"))
        names = F.concat(names, F.array_compact(F.array(*[F.when(F.col(f"__{c}").isin(*shares[c]), F.concat(F.lit(f"{c}:"), F.col(f"__{c}"))) for c in more])))
    cells, _ = common.written(cells.withColumn("names", names), "cells")
    solved = multipliers(cells.where("tokens > 0").select("names", "tokens"), goals).select(F.col("name").alias("__name"), "multiplier")
    tilt = cells.where("tokens > 0").select("cell", F.explode("names").alias("n")).join(solved, F.col("n").eqNullSafe(F.col("__name"))).groupBy("cell").agg(F.sum("multiplier").alias("tilt")).withColumnRenamed("cell", "__cell")
    facts = cells.join(tilt, F.col("cell").eqNullSafe(F.col("__cell")), "left").join(sources.select(F.col("source").alias("__s"), "total", "target"), F.col("source").eqNullSafe(F.col("__s")))
    rate = F.when(F.col("tokens") > 0, F.exp("tilt")).otherwise(1.0)
    rate = rate if more else F.least(F.lit(float(most)), rate)
    goals = facts.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int"))
    wanted = F.col("rate") * F.col("tokens") if more else F.col("target")
    goals, _ = common.written(goals.withColumn("extra", F.when(F.col("rate") - F.col("base") > 1e-9, wanted - F.col("base") * F.col("tokens")).otherwise(0.0)), "goals")
    pivots = _pivots(narrow.select(F.col("cell").alias("source"), "size", "draw"), goals.select(F.col("cell").alias("source"), "extra")).withColumnRenamed("source", "__source")
    facts = goals.join(pivots, F.col("cell").eqNullSafe(F.col("__source")), "left")
    facts, _ = common.written(facts.select("cell", F.col("total").alias("source_size"), "target", "base", "pivot", "fraction", F.coalesce("tied", F.lit(False)).alias("tied")), "mix")
    return narrow, facts


def _with_copies(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with columns __cell, __size and __draw joined to their cell's facts, and __copies.

    Rows at the pivot that agree in id, source and text are dealt singly: the fraction is spread over them by
    the multiples of the golden ratio, a phase for each partition, so no group of repeated rows moves or meets.
    """
    named = facts.select([F.col(c).alias(f"__of_{c}") for c in facts.columns])
    joined = rows.join(named, F.col("__cell").eqNullSafe(F.col("__of_cell")))
    more = F.when(F.col("__draw") < F.col("__of_pivot"), 1).when(F.col("__draw") > F.col("__of_pivot"), 0).otherwise(F.coalesce("__of_fraction", F.lit(0.0)).cast("int"))
    out = joined.withColumn("__copies", F.col("__of_base") + F.coalesce(more, F.lit(0)))
    if facts.where("tied").limit(1).count():
        tied = F.col("__of_tied") & (F.col("__draw") == F.col("__of_pivot"))
        phase = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(1 << 20)) / (1 << 20)
        turn = F.pmod(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) * GOLDEN + phase, F.lit(1.0))
        dealt = joined.where(tied).withColumn("__copies", F.col("__of_base") + (turn < F.col("__of_fraction")).cast("int"))
        out = out.where(F.coalesce(~tied, F.lit(True))).unionByName(dealt)
    return out


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, size, source_size, target, copies), a row a document: what the mix does with it.

    A document gets the whole part of its source's rate, and one copy more if its draw is below the source's pivot, so
    the tokens taken meet the target but for half a document. Null ids, sources and texts are values like any other;
    repeated rows are decided singly; a document without words has the copies of its rate, none of which counts;
    an empty table gives no rows; other columns are left out.
    """
    narrow, facts = plan(docs, id_col, text_col, source_col, **options)
    rows = narrow.select("id", "source", "size", F.col("cell").alias("__cell"), F.col("draw").alias("__draw"))
    return _with_copies(rows, facts).select("id", "source", "size", F.col("__of_source_size").alias("source_size"), F.col("__of_target").alias("target"), F.col("__copies").cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it; those of no words as they are.

    Each row is decided where it stands by the facts of its source, so texts are not shuffled while the sources' table is
    small enough for Spark to send it to the tasks, by its measured size. All columns are kept, whatever their names.
    """
    columns = docs.columns
    _, facts = plan(docs, id_col, text_col, source_col, **options)
    rows = docs.withColumns({"__cell": cell_of(source_col, options.get("shares")), "__draw": draw(id_col, text_col, source_col), "__words": size_of(F.col(text_col))})
    found = _with_copies(rows, facts).withColumn("__copies", F.when(F.col("__words") == 0, 1).otherwise(F.col("__copies")))
    return found.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document, and its copies."""
    found = decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The same in DuckDB's SQL, for tables in which no two rows agree in id, source and text. Fifty rounds of sharing, enough for the sources of the tables.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(source, ''), ':', coalesce(text, ''))), 1, 16) AS UBIGINT) >> 1 AS draw FROM documents),
s AS (SELECT source, sum(size) AS total, (ARRAY[{", ".join(f"{w}.0" for w in WEIGHTS)}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM d GROUP BY source),
shared(round, rest, free) AS (
  SELECT 0, CAST({SHARE} * sum(total) AS DOUBLE), sum(weight) FROM s
  UNION ALL
  SELECT round + 1, (SELECT CAST({SHARE} * sum(total) - coalesce(sum(CASE WHEN rest / free * weight > {MOST} * total THEN {MOST} * total END), 0) AS DOUBLE) FROM s),
         (SELECT coalesce(sum(CASE WHEN rest / free * weight > {MOST} * total THEN 0 ELSE weight END), 0) FROM s) FROM shared WHERE round < 50),
goals AS (SELECT source, total, CASE WHEN rest / free * weight > {MOST} * total THEN {MOST}.0::DOUBLE * total ELSE rest * weight / free END AS target FROM s, shared WHERE round = 50),
rates AS (SELECT *, floor(target / greatest(total, 1) + 1e-9) AS base, target - floor(target / greatest(total, 1) + 1e-9) * total AS extra FROM goals),
drawn AS (SELECT d.*, total, target, CASE WHEN total = 0 THEN 1 ELSE base END AS base, CASE WHEN extra > 1e-9 * total THEN extra ELSE 0 END AS extra,
          sum(size) OVER (PARTITION BY d.source ORDER BY draw) AS upto FROM d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM (SELECT *, base + CASE WHEN extra = 0 THEN 0 WHEN upto < extra THEN 1 WHEN upto - size >= extra THEN 0 WHEN size > 0 AND (extra - (upto - size)) / size >= 0.5 THEN 1 ELSE 0 END AS copies FROM drawn)
"""
