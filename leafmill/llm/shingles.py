"""Near-duplicate groups by the exact similarity of shingle sets, with prefix filtering of the candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, simhash

#: Words of a shingle; documents link at a Jaccard similarity of NUM / DEN or more.
WIDTH, NUM, DEN = 5, 4, 5
#: One text of so many is read for the order of shingles, and at most so many frequent shingles are placed last.
SAMPLE, FREQUENT = 16, 100_000
#: Orders by each of which one set of a shingle and a class of sizes is compared with all others of these; the classes' ratio.
ORDERS, CLASS = 4, 1.25
#: Longs of a set's coarse parity bits, which stand in the join's condition, and shingles a long of its fine ones at most.
PARITY, FINE = 4, 64


def hashes(text: str | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 of the word shingles of one text, sorted; words and short texts as in ``simhash.fingerprint``."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops)).view(np.int64))


def key(text: str | None, width: int = WIDTH, seed: int = 42) -> int:
    """64 bits, unsigned, that stand for the shingle set of one text; 0 for one without words."""
    found = hashes(text, width, seed)
    return xxhash.xxh64_intdigest(found.tobytes(), seed + 1) if len(found) else 0


def _signed(found: np.ndarray, seed: int) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), seed + 1) if len(found) else 0, np.uint64).view(np.int64))


def parity(found: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """64 * longs bits, each the parity of the shingles that fall on it.

    Two sets whose bits differ in d places differ in d shingles at least: an odd number of them fell on each.
    """
    odd = np.bincount(found & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def fine(found: np.ndarray) -> np.ndarray:
    """Parity bits in a number, a power of two, that follows that of the shingles."""
    return parity(found, max(PARITY, 1 << max(0, (len(found) - 1) // FINE).bit_length()))


_PARITY = [f"p{k}" for k in range(PARITY)]


def _frequent(texts: DataFrame, width: int, seed: int) -> np.ndarray:
    """Shingles that stand in several of the sampled texts, the rarest first. They only set an order, on which no result depends."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(t.as_py(), width, seed))], ["token"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(batches, "token long")
    found = sample.groupBy("token").count().where("count >= 4").orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").toPandas()
    return found["token"].to_numpy(np.int64)[::-1]


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = 42) -> tuple[DataFrame, str]:
    """(id, fp, sim, h, prefix, fine, p0 ...) per row of ``docs``, and the path of the table. Whole texts are cut into shingles once, here.

    h is the shingle set, sorted; fp 64 bits that stand for it; sim the text's SimHash fingerprint; prefix the shingles that two similar sets
    cannot both miss, the rarest first; the others its fine and coarse parity bits.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    frequent = _frequent(source, width, seed)
    order = np.argsort(frequent)
    known = frequent[order]

    def prefix(found: np.ndarray) -> np.ndarray:
        size = len(found)
        rank = np.zeros(size, np.int64)
        if len(known) and size:
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            rank = np.where(known[place] == found, order[place] + 1, 0)
        return found[np.argsort(rank, kind="stable")[: size + (-NUM * size // DEN) + 1 if size else 0]]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in rows:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                h = [hashes(t.as_py(), width, seed) for t in part.column(1)]
                coarse = np.stack([parity(x) for x in h]).T
                sim = np.fromiter((simhash.fingerprint(t.as_py()) for t in part.column(1)), np.uint64, part.num_rows).view(np.int64)
                columns = [pa.array([_signed(x, seed) for x in h], pa.int64()), pa.array(sim), pa.array(h, longs), pa.array([prefix(x) for x in h], longs), pa.array([fine(x) for x in h], longs)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *map(pa.array, coarse)], ["id", "fp", "sim", "h", "prefix", "fine", *_PARITY])
            common.give_back()

    schema = ", ".join([f"id {id_type}, fp long, sim long, h array<long>, prefix array<long>, fine array<long>", *[f"{c} long" for c in _PARITY]])
    return common.written(source.mapInArrow(batches, schema), "shingles")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Rows of ``prefixes`` whose token at least two different sets have, once a set. One shuffle and a pass over sorted rows."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, False  # the row before, and whether it was given
        for batch in rows:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            token, fp = (batch.column(k).to_numpy() for k in (0, 1))
            at = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (fp[1:] != fp[:-1]))))
            same = token[at[1:]] == token[at[:-1]]
            give = np.concatenate((same, [False])) | np.concatenate(([False], same))
            following = bool(give[-1]) if len(at) > 1 else given
            give[0] &= not given
            if give.any():
                yield batch.take(pa.array(at[give]))
            last, given = batch.slice(int(at[-1]), 1), following

    return prefixes.repartition("token").sortWithinPartitions("token", "fp").mapInArrow(batches, prefixes.schema)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are similar, counted shingle by shingle.

    Only sets of these pairs are looked up: a bitmap keeps the others out of the shuffle.
    """
    asked = pairs.select(F.col("u").alias("fp")).distinct().union(pairs.select("v").distinct()).distinct()  # each side once before they meet
    bits, words = common.bitmap(asked.select(F.xxhash64("fp")))
    some = sets.where(common.may_hold(bits.scalar(), F.xxhash64("fp"), words)).select("fp", "h").dropDuplicates(["fp"])
    some, path = common.written(some, "sets")
    of = lambda side: common.shuffled(some.select(F.col("fp").alias(side), F.col("h").alias(f"h{side}")))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    common_size = F.size(F.array_intersect("hu", "hv"))
    out, _ = common.written(both.where(common_size * (NUM + DEN) >= (F.size("hu") + F.size("hv")) * NUM).select("u", "v"), "links")
    common.remove(pairs.sparkSession, path)
    return out


_COARSE = "(" + " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in _PARITY) + f") * {NUM + DEN} <= (n_a + n_b) * {DEN - NUM}"


def _plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sizes and fine parity bits allow the similarity. The longer of two bitmaps is folded."""
    of = lambda side: common.shuffled(facts.select(F.col("fp").alias(side), F.col("n").alias(f"n_{side}"), F.col("fine").alias(f"fine_{side}")))
    folded = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (i, j) -> i ^ j), {x})"
    differ = f"aggregate(zip_with({folded('fine_u', 'fine_v')}, {folded('fine_v', 'fine_u')}, (i, j) -> bit_count(i ^ j)), 0, (s, x) -> s + x)"
    near = f"least(n_u, n_v) * {DEN} >= greatest(n_u, n_v) * {NUM} and {differ} * {NUM + DEN} <= (n_u + n_v) * {DEN - NUM}"
    return pairs.join(of("u"), "u").join(of("v"), "v").where(near).select("u", "v")


def _possible(n: str, at: str, m: str, there: str) -> str:
    """SQL: two sets of n and m shingles that first meet at these places can be similar."""
    return f"(least({n}, {m}) * {DEN} >= greatest({n}, {m}) * {NUM} and least({n} - {at}, {m} - {there}) * {NUM + DEN} >= ({n} + {m}) * {NUM})"


def links(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct shingle sets, of a table (fp, h, prefix, fine, p0 ...), that connect all sets of a similarity of NUM / DEN or more.

    Prefix filtering, which misses no pair: in any order of shingles, the first one that two similar
    sets share stands among the first n - ceil(0.8 n) + 1 of the larger one and the first
    n - ceil(8 n / 9) + 1 of the smaller one, and enough shingles follow it in both. Rare shingles come
    first, so a line that many documents have makes no candidates. All links are verified.

    Of the sets with one shingle and of one class of sizes, first only a few are compared with all others: the least of
    each of ``ORDERS`` orders. So a large group of near copies is put together by pairs in proportion to its size, not
    to its square. Then the sets that this leaves in different components are compared with each other; of
    these pairs only those leave the join whose coarse parity bits allow the similarity, so that near copies that are
    not near enough are not verified by their shingles one by one.
    """
    spark = sets.sparkSession
    prefixes = sets.select("fp", F.size("h").alias("n"), F.posexplode("prefix").alias("at", "token")).select("token", "fp", "n", "at")
    shared, path = common.written(_shared(prefixes).withColumn("class", F.floor(F.log("n") / math.log(CLASS)).cast("int")), "prefixes")
    facts, facts_path = common.written(sets.select("fp", F.size("h").alias("n"), "fine", *_PARITY).dropDuplicates(["fp"]), "facts")
    place = F.struct("fp", "n", "at")
    hubs = shared.groupBy("token", "class").agg(F.array_distinct(F.array(*[F.min_by(place, F.xxhash64("fp", F.lit(k))) for k in range(ORDERS)])).alias("hubs"))
    star = shared.join(common.shuffled(hubs.select("token", "class", F.explode("hubs").alias("hub"))), ["token", "class"]).where((F.col("fp") != F.col("hub.fp")) & F.expr(_possible("n", "at", "hub.n", "hub.at")))
    pairs = star.select(F.least("hub.fp", "fp").alias("u"), F.greatest("hub.fp", "fp").alias("v")).distinct()
    first, _ = common.written(_plausible(pairs, facts), "pairs")
    found = _verified(first, sets)
    component = common.connected_components(found)
    placed = shared.join(common.shuffled(component), shared.fp == component.node, "left").select("token", "fp", "n", "at", F.coalesce("component", "fp").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    rest, rest_path = common.written(placed.join(common.shuffled(mixed), "token", "left_semi").join(common.shuffled(facts.drop("n", "fine")), "fp"), "prefixes")
    a, b = (rest.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "at", "c", *_PARITY)]) for side in "ab")
    near = F.expr(
        f"""c_a <> c_b and (n_a < n_b or n_a = n_b and fp_a < fp_b) and {_possible("n_a", "at_a", "n_b", "at_b")} and at_a * {NUM + DEN} <= n_a * {DEN - NUM} and {_COARSE}"""
    )
    second = a.join(common.shuffled(b), "token").where(near).select(F.least("fp_a", "fp_b").alias("u"), F.greatest("fp_a", "fp_b").alias("v")).distinct()
    more, _ = common.written(_plausible(second.join(common.shuffled(first), ["u", "v"], "left_anti"), facts), "pairs")
    out = found if more.isEmpty() else found.union(_verified(more, sets))
    for spent in (path, rest_path, facts_path):
        common.remove(spark, spent)
    return out


def print_links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of fp, of a table (fp, sim), that connect all texts whose SimHash fingerprints ``simhash.links`` links, or are equal.

    One fp stands for all of a fingerprint, so there are no more pairs than rows and links of distinct fingerprints.
    """
    least, _ = common.written(prints.groupBy("sim").agg(F.min("fp").alias("least")), "prints")
    same = prints.join(common.shuffled(least), "sim").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    of = lambda side: common.shuffled(least.select(F.col("sim").alias(side), F.col("least").alias(f"fp_{side}")))
    near = simhash.links(least.select(F.col("sim").alias("fp"))).join(of("u"), "u").join(of("v"), "v").where("fp_u <> fp_v")
    return same.union(near.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = 42, by_print: bool = False) -> DataFrame:
    """(id, fp, component_id) for each row, as ``simhash.groups`` gives them; fp stands for the shingle set.

    With ``by_print`` also the links of SimHash fingerprints count, by the method and the limits of ``simhash``.
    """
    sets, path = hashed(docs, id_col, text_col, width, seed)
    prints, _ = common.written(sets.select("id", "fp"), "fingerprints")
    similar = common.written(sets.select("fp", "sim").distinct(), "prints")[0] if by_print else None

    def linked(_: DataFrame) -> DataFrame:
        found = links(sets.drop("id"))
        found = common.written(found if similar is None else found.union(print_links(similar)), "links")[0]
        common.remove(docs.sparkSession, path)
        return found

    return simhash.joined_groups(prints, linked)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = 42, by_print: bool = False) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id, as ``simhash.deduplicated`` keeps them."""
    return simhash.one_a_group(docs, groups(docs, id_col, text_col, width, seed, by_print), id_col, text_col, lambda t: key(t, width, seed))
