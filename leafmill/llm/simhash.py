"""Near-duplicate groups by SimHash, with pigeonring filtering of the candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common

#: Fingerprints of 64 bits on a ring of four segments; documents link at up to three differing bits.
BITS, SEGMENTS, MAX_BITS = 64, 4, 3
WIDTH = BITS // SEGMENTS


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, unsigned.

    A-Z are lower-cased and words are runs without ASCII white space; shingles repeat as often as
    they occur; a text of fewer words than ``width`` is one shingle; one without words (null or
    empty included) has fingerprint 0. A bit is set if more than half of the shingles' XXH64 have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    np.add(ends, 1, out=ends)
    np.cumsum(ends, out=ends)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), 65536):  # bounds the bit matrix of a very long text
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(stops), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) per row of ``docs``; fp holds the 64 bits as a signed long."""
    return with_prints(docs, id_col, text_col, lambda t: fingerprint(t, width, seed))


def with_prints(docs: DataFrame, id_col: str, text_col: str, of: Callable[[str | None], int]) -> DataFrame:
    """(id, fp) per row of ``docs``, by any function from a text to 64 unsigned bits."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            prints = np.fromiter((of(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(batches, f"id {id_type}, fp long")


def _rotated(column: str, k: int) -> str:
    """SQL of the fingerprint turned left by ``k`` segments, so that segment k comes first."""
    return column if k == 0 else f"(shiftleft({column}, {k * WIDTH}) | shiftrightunsigned({column}, {BITS - k * WIDTH}))"


def links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that differ in at most three bits.

    Pigeonring: if the four segments differ in three bits together, some segment k starts a chain in
    which one segment differs in 0 bits, two in at most 1, three in at most 2 and four in at most 3
    (three quarters of a bit a segment, rounded down). The first two conditions are the join key:
    the index has a row for each k with the first 32 bits of the fingerprint turned to k; the probe
    asks for those 32 bits and for each of them with one zero of the second segment set. A
    difference of one bit is thus asked for from one side only. The third condition and the full
    Hamming check stand in the join condition, so only true links leave the join. A key has 34 bits,
    so candidates stay proportional to the fingerprints where 16-bit bands would grow with the square.
    Fingerprints are distinct, so even in a dense ball one has at most C(64, 1) + C(64, 2) + C(64, 3) = 43,744
    links, and any set of which all are linked to all at most 128 members: links grow with the number of distinct
    fingerprints, not with its square, however many documents have them.
    """
    turned = prints.select("fp", F.posexplode(F.array(*[F.expr(_rotated("fp", k)) for k in range(SEGMENTS)])).alias("k", "turned"))
    keyed = turned.select("fp", "turned", F.col("k").cast("long").alias("k"), F.expr("shiftrightunsigned(turned, 32)").alias("head"))
    index = keyed.select(F.expr("shiftleft(k, 32) | head").alias("key"), F.col("fp").alias("v"), F.col("turned").alias("tv"))
    flips = F.expr("filter(transform(sequence(0, 16), b -> if(b = 16, head, if((head & shiftleft(1L, b)) = 0, head | shiftleft(1L, b), -1L))), h -> h >= 0)")
    probe = keyed.select(F.col("fp").alias("u"), F.col("turned").alias("tu"), "k", "head", F.explode(flips).alias("asked")).select(
        "u", "tu", F.expr("shiftleft(k, 32) | asked").alias("key"), (F.col("asked") != F.col("head")).alias("flipped")
    )
    near = (
        (F.col("flipped") | (F.col("u") < F.col("v")))
        & (F.bit_count(F.expr("shiftrightunsigned(tu ^ tv, 16)")) <= 2)
        & (F.bit_count(F.expr("tu ^ tv")) <= MAX_BITS)
    )
    return probe.join(common.shuffled(index), (probe.key == index.key) & near).select("u", "v")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id, kept_fp) for each row: the smallest id that links lead to, and the smallest fingerprint that this id has there.

    Rows of equal fingerprint are one node, however many they are; only distinct fingerprints are
    joined. Null ids are never a component_id unless a group has no other; rows that repeat an id are linked by their own texts; repeated rows are
    returned as often as they occur; an empty table gives no rows.
    """
    prints, _ = common.written(with_fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    return joined_groups(prints, links)


def joined_groups(prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``groups`` from written (id, fp) and a function from distinct fp to linked pairs (u, v)."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = common.connected_components(linked(nodes.select("fp")))
    labelled = nodes.join(common.shuffled(found), nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("k")).select("component", F.col("k.least").alias("component_id"), F.col("k.fp").alias("kept_fp"))
    by_print = labelled.select("fp", "component").join(common.shuffled(smallest), "component").select(F.col("fp").alias("node"), "component_id", "kept_fp")
    return prints.join(common.shuffled(by_print), prints.fp == by_print.node, "left").select("id", "fp", "component_id", "kept_fp")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id.

    A row is a document, whatever other rows have its id: rows of one id whose texts are not linked both stay. Of
    rows that agree in id and fingerprint, or have no id in a group of null ids only, the one of the smallest text stays, then of the smallest hash of all columns.
    """
    return one_a_group(docs, groups(docs, id_col, text_col, width, seed), id_col, text_col, lambda t: fingerprint(t, width, seed))


def one_a_group(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str, of: Callable[[str | None], int]) -> DataFrame:
    """``deduplicated`` by the rows of ``joined_groups``; ``of`` gives the fp of a text.

    Rows whose id no dropped row has pass where they stand, by a bitmap of the dropped ids; only the
    others, most of which go, are shuffled by id. An id that several rows have does not say which of them goes: such rows, and
    those without id, get their fp again and are decided by both.
    """
    found, _ = common.written(grouped, "groups")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("kept_fp"))
    repeated, _ = common.written(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("__id")), "repeated")
    drop, _ = common.written(found.where(F.col("id").isNotNull() & ~stays).select(F.col("id").alias("__drop")).distinct(), "dropped")
    named = docs.where(F.col(id_col).isNotNull())
    special = docs.where(F.col(id_col).isNull()) if found.where("id is null").limit(1).count() else None
    if not repeated.isEmpty():
        once, more = common.parted(named, F.col(id_col), repeated)
        named = once.unionByName(more.join(common.shuffled(repeated), F.col("__key") == F.col("__id"), "left_anti").select(*docs.columns))
        again = more.join(common.shuffled(repeated), F.col("__key") == F.col("__id"), "left_semi").select(*docs.columns)
        special = again if special is None else special.unionByName(again)
    clean, maybe = common.parted(named, F.col(id_col), drop)
    kept = clean.unionByName(maybe.join(common.shuffled(drop), F.col("__key") == F.col("__drop"), "left_anti").select(*docs.columns))
    if special is None:
        return kept
    keep = found.where(stays).select(F.col("id").alias("__id"), F.col("fp").alias("__kept")).distinct()
    rows = _with_print(special, text_col, of)
    rows = rows.join(common.shuffled(keep), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__kept")), "left_semi")
    first = Window.partitionBy(id_col, "__fp").orderBy(F.col(text_col).asc_nulls_first(), F.xxhash64(*docs.columns))
    return kept.unionByName(rows.withColumn("__turn", F.row_number().over(first)).where("__turn = 1").select(*docs.columns))


def _with_print(docs: DataFrame, text_col: str, of: Callable[[str | None], int]) -> DataFrame:
    """``docs`` with a column ``__fp``; for the few rows that have no id to join by."""
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([of(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("__fp", prints(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
