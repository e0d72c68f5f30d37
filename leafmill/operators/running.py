"""Running totals over groups of any length: range partitions, sums within each, and offsets between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.scratch import written


def group_key(group: list[str]) -> Column:
    """A long that tells neighbouring groups apart; nulls are values."""
    return F.xxhash64(*[x for c in group for x in (F.col(c).isNull(), F.col(c))]) if group else F.lit(0).cast("long")


def running_totals(rows: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``rows`` with a column of each name in ``values``: the sum of its whole numbers in the group, up to and with the row.

    Rows are dealt to range partitions by group and ``order`` and added up where they stand, so a group of any length
    is spread over as many tasks as its rows need; no window or task holds more than a range partition. Only the
    group that a partition begins with can have begun before it: its sum so far comes from one small table, which
    has two rows a partition at most and is therefore sent to all tasks.

    Null values count 0, null groups are groups, and rows that tie in ``order`` get their totals in the order in which the
    sort leaves them, so give an order without ties, or one whose ties are equal rows. An empty table gives no rows;
    columns that are called like a total are replaced by it. Sums are 64 bits wide.
    """
    names = list(values)
    own = [c for c in rows.columns if c not in names]
    spots = [f"__v{k}" for k in range(len(names))]
    keyed = rows.select(*rows.columns, *[F.coalesce(values[n].cast("long"), F.lit(0).cast("long")).alias(s) for n, s in zip(names, spots, strict=True)], group_key(group).alias("__g"))
    by = [*[F.col(c).asc_nulls_first() for c in group], *order]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*own, *spots, "__g", F.spark_partition_id().alias("__part"))
    at = len(own)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, first, seen = None, [0] * len(names), True, 0
        for batch in it:
            if not batch.num_rows:
                continue
            g = batch.column(at + len(names)).to_numpy()
            new = np.concatenate(([last is None or g[0] != last], g[1:] != g[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))  # -1: the group began in a batch before
            sums = []
            for k in range(len(names)):
                total = np.cumsum(batch.column(at + k).to_numpy())
                before = np.concatenate(([0], total))[np.maximum(begin, 0)]
                total = total - before + np.where(begin < 0, carried[k], 0)
                sums.append(pa.array(total))
                carried[k] = int(total[-1])
            starts = np.flatnonzero(new)
            later = starts[0 if last is not None else 1 :]
            edge = np.zeros(len(g), bool)
            if first:
                edge[: later[0] if len(later) else len(g)] = True
                first = not len(later)
            last, n = g[-1], np.arange(seen, seen + len(g))
            seen += len(g)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *sums, *batch.columns[at + len(names) :], pa.array(edge), pa.array(n)], [*own, *spots, "__g", "__part", "__edge", "__n"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema], "__edge boolean", "__n long"])
    local, _ = written(ordered.mapInArrow(batches, schema), "running")
    edges = local.where("__edge").select("__g", "__part").distinct()
    begun = local.join(F.broadcast(edges.select("__g").distinct()), "__g", "left_semi")  # a row a partition at most
    ends = begun.groupBy("__g", "__part").agg(F.max_by(F.struct(*spots), "__n").alias("end")).select("__g", "__part", "end.*")
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(F.col("__g").alias("__og"), F.col("__part").alias("__op"), *[F.sum(s).over(earlier).alias(f"__o{k}") for k, s in enumerate(spots)])
    found = local.join(F.broadcast(offsets.where("__o0 is not null")), (F.col("__g") == F.col("__og")) & (F.col("__part") == F.col("__op")), "left")  # two rows a partition at most
    return found.select(*own, *[(F.col(s) + F.coalesce(f"__o{k}", F.lit(0))).alias(n) for k, (n, s) in enumerate(zip(names, spots, strict=True))])
