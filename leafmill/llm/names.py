"""Joining two tables by names within a few edits, by asymmetric chunks and grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import CRC32
from leafmill.scratch import written

#: Edits that a pair may be apart, and chunks that the shorter side must share whatever these edits are.
MAX_EDITS, SHARED = 1, 2
#: Bits of a name that tell how often, odd or even, its characters fall on each.
PARITY = 64


def distance(a: str, b: str, most: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertions, deletions, substitutions and exchanges of neighbours of one code point each.

    With ``most`` only the band of that width around the diagonal is filled, and any larger distance is ``most + 1``.
    """
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    most = len(a) + len(b) if most is None else most
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    rows = [{j: j for j in range(min(len(b), most) + 1)}]
    last: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row, above = ({0: i} if i <= most else {}), rows[-1]
        match = b.rfind(x, max(0, low - most - 2), low - 1) + 1
        for j in range(low, high + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = b[j - 1] != x
            if not cost:
                match = j
            best = min(above.get(j - 1, far) + cost, row.get(j - 1, far) + 1, above.get(j, far) + 1)
            if k and m:
                best = min(best, rows[k - 1].get(m - 1, far) + (i - k - 1) + 1 + (j - m - 1))
            row[j] = best
        rows.append(row)
        last[x] = i
    return min(far, rows[-1].get(len(b), far))


def _shifts(delta: int, count: int, most: int) -> list[tuple[int, ...]]:
    """Places, relative to their own, at which ``count`` untouched chunks can stand in a text that is ``delta`` longer.

    An untouched chunk moves by the insertions less the deletions before it, and the rest of ``delta`` comes after it, so
    a move s needs abs(s) + abs(delta - s) edits; so do the ways from each move to the next.
    """
    out = []
    for moves in _products(range(-most, most + 1), count):
        path = [0, *moves, delta]
        if sum(abs(y - x) for x, y in zip(path, path[1:], strict=False)) <= most:
            out.append(moves)
    return out


def _products(values: range, count: int) -> list[tuple[int, ...]]:
    return [()] if count == 0 else [(*head, v) for head in _products(values, count - 1) for v in values]


def parity(name: Column) -> Column:
    """A long with a bit for each of ``PARITY`` classes of characters: whether the name has an odd number of them.

    An insertion or deletion turns one bit, a substitution two at most and an exchange none.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(PARITY)).cast("int"))
    codes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda k: bit(F.substring(name, k, F.lit(1))))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def _choices(count: int, deltas: list[tuple[int, list[tuple[int, ...]]]]) -> Column:
    """An array of all (delta, i, s, j, t): chunks i < j moved by s and t."""
    rows = [(d, i, s, j, t) for d, moves in deltas for s, t in moves for i in range(count) for j in range(i + 1, count)]
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("disjt", row, strict=True)]) for row in rows])


def _keyed(names: DataFrame, count: int, deltas: list) -> DataFrame:
    """(key, name, bits): a row for each choice of two stretches of the name, read as chunks of a name that is ``d`` shorter.

    The key has the length of that name and the numbers and characters of its two chunks.
    """
    rows = names.withColumn("c", F.explode(_choices(count, deltas))).select("name", "n", "bits", "c.*").withColumn("m", F.col("n") - F.col("d"))
    rows = rows.withColumn("size", F.floor(F.col("m") / count).cast("int"))
    rows = rows.withColumns({"a": F.col("i") * F.col("size") + F.col("s"), "b": F.col("j") * F.col("size") + F.col("t")}).where((F.col("size") > 0) & (F.col("a") >= 0) & (F.col("b") + F.col("size") <= F.col("n")))
    gram = lambda at: F.substring(F.col("name"), F.col(at) + 1, F.col("size"))
    return rows.select(F.xxhash64("m", "i", gram("a"), "j", gram("b")).alias("key"), "name", "bits")


def _indexed(names: DataFrame, most: int) -> DataFrame:
    """(key, name, bits): for each name, every choice of ``SHARED`` of its disjoint chunks, with the name's length and their places.

    A name of n code points has 2 * most + SHARED chunks of n // (2 * most + SHARED) code points, and a rest that is no chunk.
    """
    return _keyed(names, 2 * most + SHARED, [(0, [(0, 0)])])


def _probing(names: DataFrame, most: int) -> DataFrame:
    """(key, name, bits): for each name, all pairs of its positional grams that chunks of a name within ``most`` edits can have become."""
    return _keyed(names, 2 * most + SHARED, [(d, _shifts(d, SHARED, most)) for d in range(-most, most + 1)])


def _shortened(names: DataFrame, most: int, longest: int) -> DataFrame:
    """(key, name, bits): each name of at most ``longest`` code points with up to ``most`` of them left out, in all ways."""
    without = F.array(*[F.array(*map(F.lit, (0, *x))) for x in combinations_with_replacement(range(longest + 1), most)])  # place 0 leaves nothing out
    kept = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(""), lambda s, k: F.when(F.array_contains("without", k), s).otherwise(F.concat(s, F.substring(F.col("name"), k, F.lit(1)))))
    return names.where(F.col("n") <= longest).withColumn("without", F.explode(without)).select(F.xxhash64(kept).alias("key"), "name", "bits")


def _distances(pairs: DataFrame, left: str, right: str, most: int) -> DataFrame:
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            part["distance"] = [distance(a, b, most) for a, b in zip(part[left], part[right], strict=True)]
            yield part

    return pairs.mapInPandas(batches, f"{left} string, {right} string, distance int")


def pairs(indexed: DataFrame, probing: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(indexed, probing, distance): all pairs of names within ``max_edits`` edits, from two tables (name) of distinct, not empty names.

    The indexed side gives disjoint chunks, the probing side all grams at the places where such a chunk may stand. An
    insertion, deletion or substitution spoils one chunk, an exchange across a border two, so of 2 * max_edits + SHARED
    chunks at least SHARED are found; each choice of SHARED chunks is one key of an equi-join, which asks for
    a half of a name to agree (with one edit) and so has few candidates. Parity bits of the characters stand in the join's
    condition, so that names made of the same parts do not leave it; the exact distance of the others is counted.
    Names that are too short to have so many chunks are handled exhaustively: two names within max_edits edits are equal
    when up to max_edits characters are left out of each, and all ways to do so are the keys of a second equi-join.
    No pair is missed, and no name stands in a group with all others: both sides of each join are shuffled by key, never
    sent to all tasks, and Spark splits the keys that many names have.
    """
    short = 2 * max_edits + SHARED - 1
    described = lambda t: t.select("name", F.length("name").alias("n"), parity(F.col("name")).alias("bits"))
    left, right = described(indexed), described(probing)
    close = F.bit_count(F.col("i.bits").bitwiseXOR(F.col("p.bits"))) <= 2 * max_edits
    on = (F.col("i.key") == F.col("p.key")) & close
    of = lambda a, b: a.alias("i").join(b.alias("p").hint("merge"), on).select(F.col("i.name").alias("indexed"), F.col("p.name").alias("probing"))
    long_pairs = of(_indexed(left, max_edits), _probing(right, max_edits))
    short_pairs = of(_shortened(left.where(F.col("n") <= short), max_edits, short), _shortened(right, max_edits, short + max_edits))
    found = long_pairs.unionByName(short_pairs).distinct()
    return _distances(found, "indexed", "probing", max_edits).where(F.col("distance") <= max_edits)


def joined(clients: DataFrame, vendors: DataFrame, id_col: str = "client_id", vendor_col: str = "vendor_id", name_col: str = "name", vendor_name_col: str = "name", max_edits: int = MAX_EDITS) -> DataFrame:
    """(vendor_id, distance, n_clients, first_client_id, clients_crc), a row for each vendor and distance with a pair of names within ``max_edits``.

    n_clients counts client rows, clients_crc adds up the unsigned crc32 of their ids as decimal text. Names are taken as they are
    stored; null and empty ones take no part; a null client id counts, but is never the first and adds nothing. Vendors that
    repeat, with or without the same name, get a row each for every distance they have; repeated client rows count as often as
    they occur. Equal names are one node on either side, however many rows have them; empty tables give no rows. Other columns
    are left out, whatever their names.
    """
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    mine = clients.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).cast("string").alias("name")).where("name <> ''")
    mine, _ = written(mine.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.coalesce(F.sum(crc), F.lit(0).cast("long")).alias("crc")), "clients")
    theirs, _ = written(vendors.select(F.col(vendor_col).alias("vendor_id"), F.col(vendor_name_col).cast("string").alias("name")).where("name <> ''"), "vendors")
    found, _ = written(pairs(theirs.select("name").distinct(), mine.select("name"), max_edits), "pairs")
    sums = found.join(mine.hint("merge"), found.probing == mine.name).groupBy("indexed", "distance").agg(F.sum("n").alias("n_clients"), F.min("least").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
    return theirs.join(sums.hint("merge"), theirs.name == sums.indexed).select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")


def misspelt(vendor_id: Column, name: Column) -> Column:
    """The name with two neighbouring code points exchanged, at a place and for those vendors that the crc32 of the id tells."""
    h = F.crc32(vendor_id.cast("string").cast("binary"))
    at = (h % F.greatest(F.length(name) - 1, F.lit(1))).cast("int")
    turned = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, F.length(name)))
    return F.when((h % 2 == 0) & (F.length(name) >= 2), turned).otherwise(name)


def query(spark, sf_dir: str) -> DataFrame:
    """Clients of each vendor, whose name is misspelt first, by names at most one edit apart."""
    vendors = spark.read.parquet(f"{sf_dir}/vendors.parquet").select("vendor_id", misspelt(F.col("vendor_id"), F.col("name")).alias("name"))
    return joined(spark.read.parquet(f"{sf_dir}/clients.parquet"), vendors)


#: The same in DuckDB's SQL for one edit: names that are equal, or equal with one code point left out of one or of both at
#: the same place, or with two neighbours exchanged.
SQL = f"""
WITH c AS (SELECT client_id, name, {CRC32.format("CAST(client_id AS VARCHAR)")} AS crc FROM clients WHERE name <> ''),
h AS (SELECT vendor_id, name, length(name) AS n, {CRC32.format("CAST(vendor_id AS VARCHAR)")} AS h FROM vendors WHERE name <> ''),
v AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND n >= 2 THEN substring(name, 1, h % greatest(n - 1, 1)) || substring(name, h % greatest(n - 1, 1) + 2, 1) || substring(name, h % greatest(n - 1, 1) + 1, 1) || substring(name, h % greatest(n - 1, 1) + 3) ELSE name END AS name FROM h),
vn AS (SELECT DISTINCT name FROM v), cn AS (SELECT DISTINCT name FROM c),
vd AS (SELECT name, k, substring(name, 1, k - 1) || substring(name, k + 1) AS d FROM (SELECT name, unnest(range(1, length(name) + 1)) AS k FROM vn)),
cd AS (SELECT name, k, substring(name, 1, k - 1) || substring(name, k + 1) AS d FROM (SELECT name, unnest(range(1, length(name) + 1)) AS k FROM cn)),
vt AS (SELECT name, substring(name, 1, k - 1) || substring(name, k + 1, 1) || substring(name, k, 1) || substring(name, k + 2) AS t FROM (SELECT name, unnest(range(1, length(name))) AS k FROM vn)),
near AS (SELECT vd.name AS vendor, cd.name AS client FROM vd JOIN cd ON vd.d = cd.d AND vd.k = cd.k
  UNION SELECT vd.name, cn.name FROM vd JOIN cn ON vd.d = cn.name UNION SELECT vn.name, cd.name FROM vn JOIN cd ON vn.name = cd.d UNION SELECT vt.name, cn.name FROM vt JOIN cn ON vt.t = cn.name),
p AS (SELECT name AS vendor, name AS client, 0 AS distance FROM vn UNION ALL SELECT vendor, client, 1 FROM near WHERE vendor <> client)
SELECT v.vendor_id, CAST(p.distance AS INT) AS distance, CAST(count(*) AS BIGINT) AS n_clients, min(c.client_id) AS first_client_id, CAST(sum(c.crc) AS BIGINT) AS clients_crc
FROM p JOIN v ON v.name = p.vendor JOIN c ON c.name = p.client GROUP BY v.vendor_id, p.distance
"""
