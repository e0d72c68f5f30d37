"""As-of joins over groups of any length: the nearest point at or before, or at or after, each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.running import group_key
from leafmill.scratch import written


def asof(rows: DataFrame, points: DataFrame, group: list[str], at: str, name: str, after: bool = False) -> DataFrame:
    """``rows`` with the column ``name``: the place of the last point of the group at or before the row's place ``at``, or with ``after`` of the first one at or after it.

    ``points``: (group columns, at). Both tables are merged by place in range partitions, each of which is passed through once with the point seen
    last; only the group that a partition begins with can have points before it, and these come from a small table with a row a partition. So no
    group, however long, stands in one task, and no row meets more than one point. Places are whole numbers; rows of null place, or without such a
    point, get null; null groups are groups; repeated rows are returned as often as they occur; a column that is called ``name`` is replaced.
    """
    own = [c for c in rows.columns if c != name]
    place = F.col(at).cast("long")
    asked = rows.select(*own, place.alias("__at"), F.lit(False).alias("__point"))
    given = points.where(F.col(at).isNotNull()).select(*[F.col(c) if c in group else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in own], place.alias("__at"), F.lit(True).alias("__point"))
    merged = asked.unionByName(given).withColumn("__g", group_key(group))
    sign = F.desc_nulls_last if after else F.asc_nulls_first
    by = [*[F.col(c).asc_nulls_first() for c in group], sign("__at"), F.desc("__point")]
    ordered = merged.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    k = len(own)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, seen = None, True, 0
        value = None
        for batch in it:
            if not batch.num_rows:
                continue
            g, spot = batch.column(k + 2).to_numpy(), batch.column(k + 1).to_numpy(zero_copy_only=False).astype(bool)
            places = batch.column(k).fill_null(0).to_numpy()
            n = np.arange(seen, seen + len(g))
            new = np.concatenate(([last is None or g[0] != last], g[1:] != g[:-1]))
            begin = np.maximum.accumulate(np.where(new, n, -1))
            point = np.maximum.accumulate(np.where(spot, n, -1))
            old = begin < 0  # the group began in a batch before
            here = point >= np.where(old, seen, begin)
            found = np.where(here, places[np.maximum(point - seen, 0)], value if value is not None else 0)
            known = here | (old & (value is not None))
            starts = np.flatnonzero(new)
            later = starts[0 if last is not None else 1 :]
            edge = np.zeros(len(g), bool)
            if first:
                edge[: later[0] if len(later) else len(g)] = True
                first = not len(later)
            value = int(found[-1]) if known[-1] else None
            last, seen = g[-1], seen + len(g)
            columns = [pa.array(found, pa.int64(), mask=~known), pa.array(edge), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*own, "__at", "__point", "__g", "__part", "__found", "__edge", "__n"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema], "__found long", "__edge boolean", "__n long"])
    local, _ = written(ordered.mapInArrow(batches, schema), "asof")
    edges = local.where("__edge").select("__g", "__part").distinct()
    begun = local.join(F.broadcast(edges.select("__g").distinct()), "__g", "left_semi")  # a row a partition at most
    ends = begun.groupBy("__g", "__part").agg(F.max_by("__found", "__n").alias("end"))
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(F.col("__g").alias("__og"), F.col("__part").alias("__op"), F.last("end", ignorenulls=True).over(earlier).alias("__before")).where("__before is not null")
    joined = local.where(~F.col("__point")).join(F.broadcast(offsets), (F.col("__g") == F.col("__og")) & (F.col("__part") == F.col("__op")), "left")  # two rows a partition at most
    return joined.select(*own, F.when(F.col("__at").isNotNull(), F.coalesce("__found", "__before")).alias(name))
