"""Near-duplicate embeddings by spherical-cap filters from random product codes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common

#: Least cosine of a link.
COSINE = 0.98
#: Caps a vector should lie in on average, and at least; code words a block at least and at most; seed of the codes.
CAPS, LEAST_CAPS, CODES, SEED = 8, 10, (64, 4096), 7
#: Rows of a bucket that one task compares among themselves or with as many others.
BLOCK = 512


class Caps:
    """Filter directions: a product code over a randomly turned space.

    The space is turned by a random orthogonal matrix and cut into two blocks with ``codes`` random unit code words each; a filter direction is one code word of
    each block, scaled to length 1, so there are codes**2 directions of which only 2 * codes are
    stored. A vector lies in the cap of a direction if their product is at least ``edge``, which is set
    so that a random vector lies in ``caps`` of them on average.
    """

    def __init__(self, dim: int, codes: int, caps: float = CAPS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks = [slice(0, dim)] if dim < 4 else [slice(0, dim // 2), slice(dim // 2, dim)]
        self.codes = codes
        self.words = []
        for b in self.blocks:
            w = rng.standard_normal((codes, b.stop - b.start))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(len(self.blocks)))
        self.edge = NormalDist().inv_cdf(1 - min(0.4, caps / codes ** len(self.blocks))) / math.sqrt(dim)

    def decode(self, unit: np.ndarray, least: int = LEAST_CAPS) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all caps that the rows of ``unit`` lie in, and of each row's ``least`` best.

        List decoding: a code word of the first block stays only if the best one of the second could
        lift it over the edge, so few of the directions are looked at.
        """
        turned = unit @ self.turn
        scores = [turned[:, b] @ w.T for b, w in zip(self.blocks, self.words, strict=True)]
        if len(scores) == 1:
            kth = np.partition(scores[0], -min(least, self.codes), axis=1)[:, -min(least, self.codes)]
            return np.nonzero(scores[0] >= np.minimum(self.edge, kth)[:, None])
        first, second = scores
        ranked = np.argsort(-second, axis=1, kind="stable")
        high = np.take_along_axis(second, ranked, 1)
        top = min(least, self.codes)
        heads = -np.sort(-first, axis=1)[:, :top]
        best = np.sort((heads[:, :, None] + high[:, None, :top]).reshape(len(unit), -1), axis=1)[:, -top]
        edge = np.minimum(self.edge, best)
        rows, heads = np.nonzero(first + high[:, :1] >= edge[:, None])
        own, need = first[rows, heads], edge[rows]
        out_r, out_d, k = [], [], 0
        while len(rows):
            out_r.append(rows)
            out_d.append(heads * self.codes + ranked[rows, k])
            k += 1
            if k == self.codes:
                break
            stay = own + high[rows, k] >= need  # the sum as in best: the difference need - own may round past the last of the least
            rows, heads, own, need = rows[stay], heads[stay], own[stay], need[stay]
        return np.concatenate(out_r or [rows]), np.concatenate(out_d or [heads])


def _doubles(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors in double precision; None for null, zero, or with a null or non-finite component."""
    out = []
    for value in column:
        v = np.array([np.nan if x is None else x for x in value.as_py()], float) if value.is_valid else np.empty(0)
        out.append(v if len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _keyed(rows: DataFrame, kind: str) -> DataFrame:
    """(id, label, key, vec): key is a digest of the vector's bytes, null for rows that link with nothing."""
    id_type, label_type = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vectors = _doubles(batch.column(2))
            usable = [v is not None and ok and own for v, ok, own in zip(vectors, batch.column(1).is_valid().to_pylist(), batch.column(0).is_valid().to_pylist(), strict=True)]
            data = [(v + 0.0).astype(kind).tobytes() if u else None for v, u in zip(vectors, usable, strict=True)]  # + 0.0: one zero
            keys = [d if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["id", "label", "key", "vec"])

    return rows.mapInArrow(batches, f"id {id_type}, label {label_type}, key binary, vec binary")


def _decoded(classes: DataFrame, kind: str, codes: int, caps: float, least: int, seed: int) -> DataFrame:
    """(id, label, weight, vec, cap, caps): a row for each cap that a vector lies in."""
    id_type, label_type = classes.schema["id"].dataType.simpleString(), classes.schema["label"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Caps] = {}
        for batch in it:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                vectors = [np.frombuffer(v.as_py(), kind).astype(float) for v in part.column(3)]
                for dim in sorted({len(v) for v in vectors}):
                    mine = np.array([k for k, v in enumerate(vectors) if len(v) == dim])
                    if dim not in made:
                        made[dim] = Caps(dim, codes, caps, seed)
                    row, cap = made[dim].decode(_unit(np.stack([vectors[k] for k in mine])), least)
                    order = np.lexsort((cap, row))
                    row, cap = row[order], cap[order]
                    bounds = np.searchsorted(row, np.arange(len(mine) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cap, pa.int32()))
                    taken = part.take(pa.array(mine[row]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cap, pa.int32()), lists.take(pa.array(row))], ["id", "label", "weight", "vec", "cap", "caps"])

    return classes.mapInArrow(batches, f"id {id_type}, label {label_type}, weight long, vec binary, cap int, caps array<int>")


def _compared(rows: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(id, links, root) from buckets that stand together in a partition, in order.

    links: the weight of the rows of the bucket that a row links to, each pair in the first cap that
    its rows share only; root: the smallest id of the bucket that links lead to. Between blocks of a
    large bucket only pairs across the blocks count.
    """
    id_type = rows.schema["id"].dataType.simpleString()

    def group(t: pa.Table) -> tuple[list, list, list]:
        ids, weight = t.column("id").to_pylist(), t.column("weight").to_numpy()
        data = t.column("vec").to_pylist()
        side = t.column("side").to_numpy()
        cap = t.column("cap")[0].as_py()
        across = t.column("hi")[0].as_py() != t.column("lo")[0].as_py()
        out: tuple[list, list, list] = ([], [], [])
        for dim in {len(d) for d in data}:
            mine = np.array([k for k, d in enumerate(data) if len(d) == dim])
            if len(mine) < 2:
                continue
            unit = _unit(np.stack([np.frombuffer(data[k], kind) for k in mine]).astype(float))
            near = unit @ unit.T >= cosine
            np.fill_diagonal(near, False)
            if across:
                near &= side[mine][:, None] != side[mine][None, :]
            if not near.any():
                continue
            lists = t.column("caps").take(pa.array(mine)).to_pylist()
            at = {c: k for k, c in enumerate(sorted({c for x in lists for c in x if c < cap}))}
            earlier = np.zeros((len(mine), max(1, len(at))), np.float32)
            for k, x in enumerate(lists):
                earlier[k, [at[c] for c in x if c < cap]] = 1
            first = near & ~((earlier @ earlier.T) > 0)
            links = first @ weight[mine]
            label = np.array([ids[k] for k in mine])
            root = label.copy()
            while True:  # smallest id along links, the links of other caps included
                least = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
                if (least == root).all():
                    break
                root = least
            touched = np.flatnonzero(near.any(1))
            out[0].extend(label[touched].tolist())
            out[1].extend(links[touched].tolist())
            out[2].extend(root[touched].tolist())
        return out

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        kept: list[pa.RecordBatch] = []

        def bucket(b: pa.RecordBatch) -> np.ndarray:
            """Whether a row begins another bucket than the row before."""
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("label_key", "cap", "lo", "hi")]
            return np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))

        def done(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            starts = np.flatnonzero(bucket(table.combine_chunks().to_batches()[0])).tolist()
            ends = [*starts[1:], table.num_rows]
            rest = [] if last else table.slice(starts[-1]).to_batches()
            ids, links, roots = [], [], []
            for a, b in list(zip(starts, ends, strict=True))[: None if last else -1]:
                if b - a > 1:
                    x = group(table.slice(a, b - a))
                    ids += x[0]
                    links += x[1]
                    roots += x[2]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], schema=kinds), rest

        for batch in it:
            if batch.num_rows:
                out, kept = done(pa.Table.from_batches([*kept, batch]), False)
                yield out
        if kept:
            yield done(pa.Table.from_batches(kept), True)[0]

    return rows.mapInArrow(batches, f"id {id_type}, links long, root long")


def _dealt(buckets: DataFrame, block: int) -> DataFrame:
    """A row for each block, or pair of blocks lo and hi, in which a row of a cap is compared.

    A cap of at most ``block`` rows is one block. A larger one is cut into blocks of which every two meet. Rows of which
    half a block or more begin their lists with the same other cap have met there: they get blocks of their own, and
    these meet neither each other nor themselves. So a dense group that lies in the same caps is compared in the first only.
    """
    first = F.element_at("caps", 1)
    of_cap = Window.partitionBy("label_key", "cap")
    sizes = buckets.groupBy("label_key", "cap", first.alias("first")).count().withColumn("total", F.sum("count").over(of_cap)).where(F.col("total") > block)
    sizes, _ = common.written(sizes.withColumn("group", F.when(F.col("count") * 2 >= block, F.col("first")).otherwise(-1)), "sizes")
    parts = sizes.groupBy("label_key", "cap", "group").agg(F.ceil(F.sum("count") / block).cast("int").alias("parts"))
    before = F.sum("parts").over(of_cap.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("parts")
    parts = parts.withColumns({"start": before.cast("int"), "all": F.sum("parts").over(of_cap).cast("int")})
    hot = sizes.join(parts, ["label_key", "cap", "group"]).select(F.col("label_key").alias("__l"), F.col("cap").alias("__c"), F.col("first").alias("__f"), "group", "parts", "start", "all")
    hot, _ = common.written(hot, "hot")  # its size is known then, and Spark sends it to the tasks if it is small
    on = (F.col("label_key") == F.col("__l")) & (F.col("cap") == F.col("__c")) & (first == F.col("__f"))
    cut = buckets.join(hot, on, "left").withColumn("side", F.when(F.col("all").isNull(), 0).otherwise(F.col("start") + F.expr("cast(pmod(xxhash64(id), parts) as int)")))
    met = (F.col("group") >= 0) & (F.col("group") < F.col("cap"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda b: ~met | (b < F.col("start")) | (b >= F.col("start") + F.col("parts")))
    partner = F.when(F.col("all").isNull(), F.array(F.lit(0))).otherwise(others)
    dealt = cut.withColumn("other", F.explode(partner)).withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    return dealt.select("id", "weight", "vec", "caps", "label_key", "cap", "lo", "hi", "side")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, caps: float = CAPS, least: int = LEAST_CAPS, block: int = BLOCK, codes: int | None = None, seed: int = SEED) -> DataFrame:
    """(id, n_links, component_id) for each row of ``vectors``.

    Rows link if their labels are equal and not null and the cosine in double precision is at least
    ``cosine``; n_links counts the other rows linked directly, component_id is the smallest id that
    links lead to. Vectors that are null, zero, or hold null or non-finite components, and rows of
    null label or id, link with nothing; vectors of different lengths do not link. Ids are integers.

    Equal vectors of a label become one class with a weight. Classes meet in the caps that both lie in;
    cosines are computed in numpy a bucket at a time and only sums and spanning links leave it. Buckets
    over ``block`` rows are cut into blocks and pairs of blocks (see :func:`_dealt`), so a task holds two blocks at most;
    other columns are left out, whatever their names; an empty table gives no rows. The
    number of code words follows the number of classes, which keeps buckets small at any size.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kind = "<f4" if "array<float>" in rows.schema["vector"].dataType.simpleString() else "<f8"  # no more bytes than the table has
    keyed, _ = common.written(_keyed(rows, kind), "vectors")
    classes = keyed.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes, _ = common.written(classes, "classes")
    if codes is None:
        codes = min(CODES[1], max(CODES[0], 1 << math.ceil(math.log2(math.sqrt(max(1, classes.count())) / 2 + 1))))
    buckets, _ = common.written(_decoded(classes.select("id", "label", "weight", "vec"), kind, codes, caps, least, seed).withColumn("label_key", F.xxhash64("label")), "caps")
    dealt = _dealt(buckets, block).repartition("label_key", "cap", "lo", "hi").sortWithinPartitions("label_key", "cap", "lo", "hi")
    found, _ = common.written(_compared(dealt, kind, cosine), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = common.connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    by_class = (
        classes.select(F.col("label").alias("__label"), F.col("key").alias("__key"), F.col("id").alias("rep"), "weight")
        .join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("__label", "__key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    joined = keyed.select("id", "label", "key").join(by_class, (F.col("key") == F.col("__key")) & (F.col("label") == F.col("__label")), "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs of a label, in DuckDB's SQL; for tables small enough for that.
SQL = f"""
WITH RECURSIVE v AS (SELECT * FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u), c AS (SELECT u, min(w) AS c FROM r GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
