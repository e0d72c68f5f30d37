"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common

#: A cut is a word end whose gear hash is the least among so many word ends before and behind it; bytes of a chunk at most;
#: words, or bytes, that consecutive repeated chunks need to be cut out as one passage.
REACH, MOST, MIN_WORDS, MIN_BYTES = 3, 512, 25, 250
#: Bytes without white space behind which characters may end a word, and bits of the hash that must be zero there.
UNSPACED, UNSPACED_BITS = 64, 4
#: A digest is hot if it has more than 1 / (HOT * shuffle partitions) of all chunks, so there are at most that many; never with fewer chunks than LEAST_HOT.
HOT, LEAST_HOT = 8, 1000
#: What names a document.
DOCUMENT = ["id", "text_key"]


def _gear() -> np.ndarray:
    """The 256 random words of the gear hash, from a fixed rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=2, person=b"gear").digest(), "little") for b in range(256)], np.uint16)


GEAR = _gear()
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: h = 2 h + gear[byte] modulo 2**16, so a hash sees 16 bytes.

    The sum over the 16 last bytes is built by doubling: 1, 2, 4, 8 and 16 bytes. The short reach lets cuts
    agree soon after the start of a passage that stands in two texts.
    """
    h = GEAR[data]
    for reach in (1, 2, 4, 8):
        if len(h) <= reach:
            break
        shifted = h[:-reach] << np.uint16(reach)
        h = h.copy()
        h[reach:] += shifted
    return h


def _word_ends(raw: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places where a word ends: behind white space; in text that has had none for long, behind some characters, by the hash."""
    space = SPACES[raw]
    places = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(space, places, -1))
    if len(raw) > UNSPACED and (places - last).max() >= UNSPACED:
        whole = np.append(raw[1:] & 0xC0 != 0x80, True)  # the next byte begins a character
        space = space | ((places - last >= UNSPACED) & whole & (h >> np.uint16(16 - UNSPACED_BITS) == 0))
    return np.flatnonzero(space) + 1


def cuts(data: bytes, reach: int = REACH, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data``; together the chunks are the data.

    A word end is a cut if its gear hash is not above those of the ``reach`` word ends before it and behind it; where a
    word repeats, each of its ends is. So a cut depends on a few words around it only: an insertion moves no cut farther
    away, and a passage in two texts is cut alike but for a few words at its ends. Chunks have 2 * reach + 1 words
    on average; a longer one than ``most`` bytes is cut there, at the character before.
    """
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = rolling(raw)
    at = _word_ends(raw, h)
    value = h[at - 1].astype(np.int32)
    least = np.ones(len(at), bool)
    for k in range(1, reach + 1):
        if len(at) > k:
            least[k:] &= value[k:] <= value[:-k]
            least[:-k] &= value[:-k] <= value[k:]
    out, start = [], 0
    for end in [*at[least].tolist(), len(data)]:
        while end - start > most:
            stop = start + most
            while stop > start + 1 and data[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(stop)
            start = stop
        if end > start:
            out.append(end)
            start = end
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, most: int = MOST) -> DataFrame:
    """(id, text_key, pos, length, words, d1, d2) of every chunk; pos in bytes of the UTF-8 text, words those that begin in it.

    id and text_key, a hash of the text, name a document together: rows that share an id without sharing a text are others.

    The digest is 16 bytes of BLAKE2b as two longs, so that equal digests are equal chunks at any scale.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where("id is not null")
    id_type = source.schema["id"].dataType.simpleString()
    names = ["id", "text_key", "pos", "length", "words", "d1", "d2"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            take, parts, held = [], [], 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                at = pa.array(np.concatenate(take))
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)], names)

            for k, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ends = cuts(data, reach, most)
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                digests = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)])
                d = np.frombuffer(digests, "<i8").reshape(-1, 2)
                space = SPACES[np.frombuffer(data, np.uint8)]
                begins = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])))))
                first, last = np.array(starts, np.int64), np.array(ends, np.int64)
                take.append(np.full(len(ends), k, np.int32))
                parts.append((first.astype(np.int32), (last - first).astype(np.int32), (begins[last] - begins[first]).astype(np.int32), d[:, 0], d[:, 1]))
                held += len(ends)
                if held > 50_000:  # bounds the rows made of a batch of long texts
                    yield flush()
                    take, parts, held = [], [], 0
            if held:
                yield flush()

    return source.mapInArrow(batches, f"id {id_type}, text_key long, pos int, length int, words int, d1 long, d2 long")


def _later(found: DataFrame) -> DataFrame:
    """Chunks that are not the first of their digest (smallest id, then hash of the text, then position), with ``own``: the first is in the same document.

    Hot digests are found in two counts, by cells of the digest and then exactly in the cells that are large; by their
    definition they are few, whatever the input, so their firsts go to all tasks and their chunks are not
    shuffled. All others are shuffled once, by digest, in groups of bounded size.
    """
    spark = found.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = 1 << max(14, (32 * partitions - 1).bit_length())
    counts, _ = common.written(found.groupBy(F.col("d1").bitwiseAND(F.lit(cells - 1)).alias("cell")).count(), "cells")
    bound = max(LEAST_HOT, (counts.agg(F.sum("count")).first()[0] or 0) // (HOT * partitions))
    large = counts.where(F.col("count") > bound).select(F.col("cell").alias("__cell"))
    place = F.struct("id", "text_key", "pos")
    inside = found.join(F.broadcast(large), F.col("d1").bitwiseAND(F.lit(cells - 1)) == F.col("__cell"), "left_semi")  # at most HOT * partitions cells
    hot = inside.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") > bound)
    hot, _ = common.written(hot.select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "first"), "hot")
    on = (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2"))
    of_hot = found.join(F.broadcast(hot), on).drop("__d1", "__d2")  # at most HOT * partitions digests
    of_rest = found.join(F.broadcast(hot), on, "left_anti").withColumn("first", F.min(place).over(Window.partitionBy("d1", "d2")))
    return of_hot.unionByName(of_rest).where(place != F.col("first")).select(*DOCUMENT, "pos", "length", "words", ((F.col("id") == F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).alias("own"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, **options: int) -> DataFrame:
    """(id, text_key, spans, own): spans (pos, stop, words) in bytes of each document that an earlier document has already, and that it has itself before.

    Of the chunks with one digest the first (smallest id, then hash of the text, then position) stays. A run of neighbouring
    repeated chunks is a passage, and counts if it has ``min_words`` words or ``min_bytes`` bytes: shorter
    ones are turns of phrase. Texts are read and cut once. Runs are numbered by a window over a document's
    repeated chunks, so a very long text is no array that grows.
    """
    found, _ = common.written(chunks(docs, id_col, text_col, **options), "chunks")
    of_doc = Window.partitionBy(*DOCUMENT, "own").orderBy("pos")
    later = _later(found).repartition(*DOCUMENT).dropDuplicates([*DOCUMENT, "pos"]).withColumn("before", F.lag(F.col("pos") + F.col("length")).over(of_doc))
    runs = later.withColumn("run", F.sum(F.when(F.col("before") == F.col("pos"), 0).otherwise(1)).over(of_doc.rowsBetween(Window.unboundedPreceding, 0)))
    passages = runs.groupBy(*DOCUMENT, "own", "run").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("length")).alias("stop"), F.sum("words").cast("int").alias("words"))
    long = passages.where((F.col("words") >= min_words) | (F.col("stop") - F.col("pos") >= min_bytes))
    span = F.struct("pos", "stop", "words")
    return long.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(F.when(~F.col("own"), span))).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("own"), span))).alias("own"))


def _cut_out():
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is None or s is None:
                out.append(t)
                continue
            data, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            for span in s:
                parts.append(data[at : span["pos"]])
                at = span["stop"]
            out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    return cut


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: bool = True, **options: int) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; with ``within`` a document's own repetitions too.

    Null texts stay null and empty ones empty; rows of null id are not compared and stay as they are;
    rows that agree in id and text are one document and are cut alike, rows that share an id only are documents of their own;
    all columns are kept. Only documents with passages are shuffled (and as many more as a bitmap of their ids lets through).
    """
    columns = docs.columns
    both = F.array_sort(F.concat("spans", "own")) if within else F.col("spans")
    spans, _ = common.written(repeats(docs, id_col, text_col, **options).select(F.struct(*DOCUMENT).alias("__document"), both.alias("__spans")).where(F.size("__spans") > 0), "spans")
    clean, maybe = common.parted(docs, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key")), spans.select("__document"))
    joined = maybe.join(spans, F.col("__key") == F.col("__document"), "left")
    return clean.unionByName(joined.withColumn(text_col, _cut_out()(F.col(text_col), F.col("__spans"))).select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes; n_spans, repeated_bytes, repeated_words, spans as text and whether there are any, of passages that an earlier document has; n_own_spans, own_words and own_spans of those that it has before itself."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeats(docs).select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key"), "spans", "own")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    joined = sizes.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("text_key") == F.col("__text_key")), "left")
    none = F.array().cast("array<struct<pos:int,stop:int,words:int>>")
    joined = joined.withColumns({"spans": F.coalesce("spans", none), "own": F.coalesce("own", none)})
    total = lambda column, of: F.aggregate(column, F.lit(0).cast("long"), lambda a, s: a + of(s))
    as_text = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["pos"], s["stop"])), ",")
    return joined.select(
        "doc_id", "n_bytes", F.size("spans").cast("long").alias("n_spans"), total("spans", lambda s: s["stop"] - s["pos"]).alias("repeated_bytes"),
        total("spans", lambda s: s["words"]).alias("repeated_words"), as_text("spans").alias("spans"), (F.size("spans") > 0).alias("repeated"),
        F.size("own").cast("long").alias("n_own_spans"), total("own", lambda s: s["words"]).alias("own_words"), as_text("own").alias("own_spans"),
    )
