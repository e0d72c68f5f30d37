"""Helpers shared by the training-data operators: durable tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.memory import give_back
from leafmill.scratch import remove, scratch_path, shared_dir, written

__all__ = ["BITMAP_WORDS", "CRC32", "bitmap", "connected_components", "give_back", "hash_of", "may_hold", "parted", "remove", "scratch_path", "shared_dir", "shuffled", "written"]

#: crc32 of a text in DuckDB's SQL, unsigned: bytes and their bits one by one.
CRC32 = """xor(list_reduce(list_transform(range(1, strlen({0}) + 1), lambda i: CAST(ord(substr({0}, i, 1)) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"""


def hash_of(*columns: str) -> Column:
    """The first 64 bits of the MD5 of the columns as text, with colons between; null is like empty."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


#: Longs of a bitmap at least and at most: 2**24 bits, 2 MB, whatever it has to hold; 128 bits a key between.
BITMAP_WORDS = (1 << 8, 1 << 18)


def bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """One row, ``bits`` (array<long>), written, and the number of its longs: two bits for each long of the one column of ``keys``.

    The bits are gathered by word on the executors, then by 64 words; the last task orders a few thousand rows at
    most, a number that does not grow with the keys.
    """
    h = F.col(keys.columns[0])
    words = min(BITMAP_WORDS[1], max(BITMAP_WORDS[0], 1 << (keys.count() * 2).bit_length()))
    spot = lambda low, bit: F.struct((F.shiftrightunsigned(h, low).bitwiseAND(F.lit(words - 1))).alias("w"), F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(63)).cast("int").alias("b"))
    set_bits = keys.where(h.isNotNull()).select(F.explode(F.array(spot(0, 36), spot(18, 42))).alias("s")).groupBy(F.col("s.w").alias("w")).agg(F.expr("bit_or(shiftleft(1L, s.b))").alias("x"))
    none = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    by_word = set_bits.union(none).groupBy("w").agg(F.bit_or("x").alias("x"))
    ordered = lambda a, b: F.array_sort(F.collect_list(F.struct(a, b)))
    parts = by_word.groupBy(F.shiftright("w", 6).alias("g")).agg(ordered("w", "x").alias("l")).select("g", F.expr("l.x").alias("part"))
    return written(parts.agg(ordered("g", "part").alias("l")).select(F.flatten(F.expr("l.part")).alias("bits")), "bitmap")[0], words


def may_hold(bits: Column, h: Column, words: int) -> Column:
    """False if the long ``h`` is surely not among the keys of the bitmap of so many longs; null is not."""
    hit = lambda low, bit: F.getbit(F.get(bits, F.shiftrightunsigned(h, low).bitwiseAND(F.lit(words - 1)).cast("int")), F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.coalesce(hit(0, 36) & hit(18, 42), F.lit(False))


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` for a join of which both sides grow with the input: it is merged, never sent whole through the driver.

    Spark sizes a side by its files or by the rows below an explode, before the join as well as while it runs, so it would broadcast
    one of many times the threshold.
    """
    return side.hint("merge")


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key is surely not in the one column of ``keys``, and the others with their key as ``__key``.

    A bitmap of bounded size decides row by row, so wide rows that no key concerns are not shuffled. Beyond some
    ten million keys it lets more and more rows through to the join that must follow; none are lost.
    """
    bits, words = bitmap(keys.select(F.xxhash64(keys.columns[0])))
    marked = rows.withColumn("__key", key).withColumn("__maybe", F.col("__key").isNotNull() & may_hold(bits.scalar(), F.xxhash64("__key"), words))
    return marked.where(~F.col("__maybe")).drop("__key", "__maybe"), marked.where("__maybe").drop("__maybe")


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: two columns of one orderable type; direction, repeats and self-loops do not matter.
    Returns (node, component) for every node that has an edge to another node; the component is
    its smallest node. Each round is written to the shared folder, so no plan grows with the number
    of rounds, and neither edges nor components reach the driver: it sees one count and one checksum
    a round.
    """
    spark = edges.sparkSession
    start = (
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current, path = written(start, "edges")
    state = _checksum(current)
    while state[0]:
        following, new_path = written(_small_star(_large_star(current)), "edges")
        new_state = _checksum(following)
        remove(spark, path)
        current, path = following, new_path
        if new_state == state:
            break
        state = new_state
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(current.select("v", "v").distinct())
    )


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(shuffled(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()
