"""The prefix trie of conversations, by an external mergesort that knows how much neighbouring sequences have in common."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import CRC32
from leafmill.operators.running import running_totals
from leafmill.scratch import written

#: Turns of a stretch: longer conversations are cut into several, so that no row grows with a conversation.
STRETCH = 256
#: Sequences, and turns, of a sorted run and of a merged range.
ROWS, TURNS = 8192, 1 << 18
#: Conversations of one family begin alike: the first of so many, and the most turns they take from it, plus one.
FAMILY, TAKEN = 5, 9


# ---- sequences ----


def turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, key, bytes): each turn with its place in its conversation from 0, a digest of role and text, and the bytes of the text.

    Null turns come first, turns that tie are ordered by digest; null roles and texts are empty; rows of null conv_id are left out.
    Places are running totals over range partitions, so a conversation may have any part of all rows. Texts are not shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("key"), F.octet_length(text).cast("long").alias("bytes")).where("conv is not null")
    placed = running_totals(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("key").asc()], {"at": F.lit(1)})
    return placed.select("conv", (F.col("at") - 1).alias("at"), "key", "bytes")


def crc(value: Column) -> Column:
    """Unsigned crc32 of a number as decimal text."""
    return F.crc32(value.cast("string").cast("binary"))


def rebuilt(placed: DataFrame) -> DataFrame:
    """``turn_rows`` of conversations that begin like the first of their family: (conv, at, key, bytes), and a last row of null key at each end.

    Conversation c takes the first h turns of conversation c - c % 5, or all if it has fewer, and then its own behind its first
    h; h is the crc32 of c modulo 9. All joins are by conversation; where one has most rows, Spark splits them.
    """
    sizes, _ = written(placed.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    convs = sizes.select("conv", "n", (crc(F.col("conv")) % TAKEN).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    first = sizes.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    facts, _ = written(convs.join(first, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("size")), "families")
    own = placed.where(F.col("at") >= crc(F.col("conv")) % TAKEN).join(facts, "conv").select("conv", (F.col("taken") + F.col("at") - F.col("h")).alias("at"), "key", "bytes")
    heads = placed.where(F.col("at") < TAKEN - 1).withColumnRenamed("conv", "base").join(facts, "base").where("at < h").select("conv", "at", "key", "bytes")
    return own.unionByName(heads).unionByName(plain_ends(facts))


def plain_ends(sizes: DataFrame) -> DataFrame:
    """A row of null key behind the last turn of each (conv, size)."""
    return sizes.select("conv", F.col("size").alias("at"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("bytes"))


def stretches(rows: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, int]:
    """(conv, level, head, next, keys, bytes) of each ``stretch`` turns of a conversation, written, and the highest level.

    head stands for all turns before the stretch and next for all with it. A conversation whose turns end where a
    stretch does has an empty one behind it, so it ends in its last stretch.
    """
    cell = F.struct("at", "key", "bytes")
    grouped = rows.withColumn("level", F.floor(F.col("at") / stretch).cast("int")).groupBy("conv", "level").agg(F.array_sort(F.collect_list(cell)).alias("t"))
    turns = F.filter("t", lambda x: x["key"].isNotNull())
    cut, _ = written(grouped.select("conv", "level", F.transform(turns, lambda x: x["key"]).alias("keys"), F.transform(turns, lambda x: x["bytes"]).alias("bytes")), "stretches")
    top = cut.agg(F.max("level")).first()[0] or 0
    if not top:
        return cut.withColumns({"head": F.lit(""), "next": F.lit("")}), 0
    digest = F.sha2(F.concat(F.col("level").cast("string"), F.lit(":"), F.array_join(F.transform("keys", F.hex), "")).cast("binary"), 256)
    parts = {f"h{k}": F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)}  # sums of 40 bits each, which stay within a long
    upto = running_totals(cut.withColumns({f"d{k}": parts[f"h{k}"] for k in range(4)}), ["conv"], [F.col("level").asc()], {f"h{k}": F.col(f"d{k}") for k in range(4)})
    before = F.concat_ws(":", "level", *[F.col(f"h{k}") - F.col(f"d{k}") for k in range(4)])
    after = F.concat_ws(":", F.col("level") + 1, *[F.col(f"h{k}") for k in range(4)])
    return written(upto.select("conv", "level", F.when(F.col("level") == 0, "").otherwise(before).alias("head"), after.alias("next"), "keys", "bytes"), "stretches")[0], top


# ---- sorted runs and their merging ----


class Item(NamedTuple):
    """A sequence in a run: its first element stands for what comes before, lcp counts the elements it shares with the item before it in the run."""

    seq: list
    conv: int
    lcp: int
    bytes: list
    tail: tuple | None


def common_prefix(a: list, b: list, start: int = 0) -> int:
    """Leading elements that two sequences share, if they share ``start``."""
    end = min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    return start


class Merger:
    """A loser tree over sorted runs whose items carry common prefixes with the item before.

    Each loser remembers how much it shares with the winner it lost to. Of two candidates the one that shares more with
    the last winner is smaller, without a look at its elements; only if they share equally much are elements compared, from
    there on. So no shared turn is compared again.
    """

    def __init__(self, runs: list[list[Item]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.loser = [(-1, 0)] * self.size  # (run, elements shared with the winner)
        self.winner = self._build(1)
        self.compared = 0

    def _head(self, run: int) -> Item | None:
        return self.runs[run][self.at[run]] if 0 <= run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _play(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser) of two (run, elements shared with the last winner)."""
        x, y = self._head(a[0]), self._head(b[0])
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        shared = common_prefix(x.seq, y.seq, a[1])
        self.compared = getattr(self, "compared", 0) + shared - a[1] + 1
        p, q = x.seq[shared : shared + 1], y.seq[shared : shared + 1]
        first = (p, x.conv) <= (q, y.conv)
        return (a, (b[0], shared)) if first else (b, (a[0], shared))

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return node - self.size, 0
        won, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return won

    def __iter__(self) -> Iterator[tuple[Item, int]]:
        """Items in order, each with the elements that it shares with the one before."""
        while (item := self._head(self.winner[0])) is not None:
            run, shared = self.winner
            yield item, shared
            self.at[run] += 1
            following = self._head(run)
            now = (run, following.lcp if following else 0)
            node = (self.size + run) // 2
            while node:
                now, self.loser[node] = self._play(now, self.loser[node])
                node //= 2
            self.winner = now


_ROW = "run long, no int, lcp int, conv long, head string, keys array<binary>, bytes array<long>, tail struct<children:long,leaves:long,saved:long,ends:string>"


def sorted_runs(rows: DataFrame, most_rows: int = ROWS, most_turns: int = TURNS) -> DataFrame:
    """``rows`` (conv, head, keys, bytes, tail) in sorted runs of bounded size, with the elements that each shares with the one before."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns, made = 0, 0

        def run(part: int) -> pa.RecordBatch:
            held.sort(key=lambda r: r[:3])
            lcp = [0, *(common_prefix([a[0], *a[1]], [b[0], *b[1]]) for a, b in zip(held, held[1:], strict=False))]
            columns = zip(*held, strict=True)
            heads, keys, conv, sizes, tail = (list(c) for c in columns)
            numbers = [pa.array([(part << 32) + made] * len(held), pa.int64()), pa.array(range(len(held)), pa.int32()), pa.array(lcp, pa.int32())]
            tails = pa.array(tail, pa.struct([("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]))
            arrays = [*numbers, pa.array(conv, pa.int64()), pa.array(heads, pa.string()), pa.array(keys, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64())), tails]
            return pa.RecordBatch.from_arrays(arrays, ["run", "no", "lcp", "conv", "head", "keys", "bytes", "tail"])

        part = 0
        for batch in it:
            for head, keys, conv, sizes, tail, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((head, keys, conv, sizes, tail))
                turns += len(keys)
                if len(held) >= most_rows or turns >= most_turns:
                    yield run(part)
                    held, turns, made = [], 0, made + 1
        if held:
            yield run(part)

    return rows.select("head", "keys", "conv", "bytes", "tail", F.spark_partition_id().cast("long").alias("part")).mapInArrow(batches, _ROW)


# ---- nodes ----

_NODE = [
    ("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("head", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("bytes", pa.int64()), ("path", pa.list_(pa.binary())), ("part", pa.int64()), ("tail", pa.struct([("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])),
]
_NODE_SQL = "kind int, node binary, parent binary, head string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, bytes long, path array<binary>, part long, tail struct<children:long,leaves:long,saved:long,ends:string>"
#: Nodes that one range has whole, those of them whose parent it has not, what one range knows of a node that others may have too, and the ids that end there.
WHOLE, BELOW, PART, IDS = range(4)


class _Open:
    """A node on the path that is open: what the items so far say of it."""

    __slots__ = ("bytes", "children", "closed", "conv", "ends", "first", "key", "leaves", "n", "saved", "tail")

    def __init__(self, key: bytes | str, size: int, first: bool):
        self.key, self.bytes, self.first = key, size, first  # first: on the path of the range's first item
        self.n = self.children = self.leaves = self.saved = 0
        self.conv: int | None = None
        self.ends: list[str] = []
        self.closed: list[dict] = []
        self.tail: tuple | None = None


def _sha(ids: str) -> str:
    return hashlib.sha256(ids.encode()).hexdigest()


def _identity(path: list[_Open]) -> list[bytes]:
    """A digest for each node of a path: of its own key and the digest above."""
    out, above = [], b""
    for x in path:
        above = hashlib.sha256(above + (x.key if isinstance(x.key, bytes) else b"head:" + x.key.encode())).digest()[:16]
        out.append(above)
    return out


def range_nodes(items: Iterator[tuple[Item, int]], part: int) -> Iterator[dict]:
    """Nodes of one merged range, as the open path gives them up.

    A node is finished when the merged stream leaves it. Nodes on the path of the first item, and those open at the end, may go on
    in other ranges: of these, at most two paths, only what this range adds is given, under a digest of the whole prefix.
    """
    path: list[_Open] = []

    def close(last: bool) -> Iterator[dict]:
        x = path[-1]
        whole = not (x.first or last)
        ids = _identity(path) if not whole else []
        path.pop()
        above = path[-1] if path else None
        row = {"depth": len(path), "conv_id": x.conv, "n_convs": x.n, "bytes": x.bytes, "part": part, "head": path[0].key if path else x.key}
        if whole:
            own = (x.n - 1) * x.bytes
            if x.tail:
                children, leaves, saved, ends = x.tail["children"], x.tail["leaves"], x.tail["saved"] + own, x.tail["ends"]
            else:
                children, leaves, saved, ends = x.children, x.leaves + (not x.children), x.saved + own, _sha(",".join(x.ends))
            found = row | {"kind": WHOLE, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends}
            for child in x.closed:
                yield child | {"parent_conv_id": x.conv}
            if above:
                above.children += 1
                above.leaves += leaves
                above.saved += saved
                above.closed.append(found)
            else:
                yield found
        else:
            for child in x.closed:
                yield child | {"kind": BELOW, "parent": ids[-1]}
            yield row | {"kind": PART, "node": ids[-1], "parent": ids[-2] if len(ids) > 1 else None, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "path": ids, "tail": x.tail}
            if x.ends:
                yield {"kind": IDS, "node": ids[-1], "part": part, "ends": ",".join(x.ends)}
            if above:
                above.leaves += x.leaves
                above.saved += x.saved
        if above:
            above.n += x.n
            above.conv = x.conv if above.conv is None else min(above.conv, x.conv)

    begun = False
    for item, shared in items:
        while len(path) > shared:
            yield from close(False)
        for k in range(len(path), len(item.seq)):
            path.append(_Open(item.seq[k], item.bytes[k - 1] if k else 0, not begun))
        begun = True
        end = path[-1]
        end.n += 1
        end.conv = item.conv if end.conv is None else min(end.conv, item.conv)
        if item.tail is None:
            end.ends.append(str(item.conv))
        else:
            end.tail = item.tail
    while path:
        yield from close(True)


def merged(runs: DataFrame, ranges: int) -> DataFrame:
    """Rows of ``range_nodes`` from sorted runs: ranges of all sequences are dealt to tasks, each merges the parts of the runs that fall to it."""
    dealt = runs.repartitionByRange(ranges, "head", "keys", "conv").sortWithinPartitions("run", "no").withColumn("part", F.spark_partition_id().cast("long"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[list[Item]] = []
        last, part = None, 0
        for batch in it:
            for run, _, lcp, conv, head, keys, sizes, tail, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run != last:
                    slices.append([])
                    last = run
                slices[-1].append(Item([head, *keys], conv, lcp, sizes, tail))
        out: list[dict] = []
        schema = pa.schema(_NODE)
        for row in range_nodes(iter(Merger(slices)), part) if slices else ():
            out.append(row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.mapInArrow(batches, _NODE_SQL)


def _digests(pieces: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids that end at a node, from pieces in order of ranges; a task holds one piece at a time."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in it:
            nodes, ends = [], []
            for node, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        nodes.append(now)
                        ends.append(sha.hexdigest())
                    now, sha = node, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(ends, pa.string())], ["node", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends"])

    return pieces.select("node", "part", "ends").repartition("node").sortWithinPartitions("node", "part").mapInArrow(batches, "node binary, ends string")


def _level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes of the sequences of one level, and those of depth 0 with their heads."""
    runs, _ = written(sorted_runs(rows), "runs")
    size = runs.agg(F.count("*").alias("n"), F.sum(F.size("keys")).alias("turns")).first()
    found, _ = written(merged(runs, max(1, -(-size["n"] // ROWS), -(-(size["turns"] or 0) // TURNS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "nodes")
    parts = found.where(F.col("kind") == PART)
    total = parts.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "head", "depth", "bytes", "path")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("tail", ignorenulls=True).alias("tail")
    )
    total, _ = written(total, "shared")
    below = total.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more")).where("node is not null")
    ends = _digests(found.where(F.col("kind") == IDS)).withColumnRenamed("ends", "digest")
    joined = total.join(below, "node", "left").join(ends, "node", "left")
    children = F.col("n_children") + F.coalesce("more", F.lit(0).cast("long"))
    own = joined.withColumn("n_children", F.coalesce("tail.children", children)).withColumns({
        "own_leaves": F.coalesce("tail.leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")),
        "own_saved": (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("tail.saved", F.lit(0).cast("long")),
        "ends": F.coalesce("tail.ends", "digest", F.lit(_sha(""))),
    })
    own, _ = written(own.drop("tail", "more", "digest", "bytes"), "shared")
    up = own.select(F.explode("path").alias("node"), "own_leaves", "own_saved").groupBy("node").agg(F.sum("own_leaves").alias("l"), F.sum("own_saved").alias("s"))
    shared = own.join(up, "node").select("node", "parent", "head", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("l")).alias("n_leaves"), (F.col("saved_tokens") + F.col("s")).alias("saved_tokens"), "ends")
    shared, _ = written(shared, "shared")
    rest = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    open_ended = found.where(F.col("kind") == BELOW).select("parent", *rest).unionByName(shared.select("parent", *rest))
    known = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = found.where(F.col("kind") == WHOLE)
    nodes = whole.select("parent_conv_id", *rest).unionByName(open_ended.join(known, "parent", "left").select("parent_conv_id", *rest))
    return nodes, whole.where("depth = 0").select("head", *rest).unionByName(shared.where("depth = 0").select("head", *rest))


def trie(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv, at, key, bytes), where a row of null key stands behind each sequence.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each distinct prefix, the empty one
    included: the smallest conv that begins with it, those of its parent, and how many do; its children; the leaves below it; the bytes
    of last turns that need not be read again below it, (n_convs - 1) times their bytes each; SHA-256 of the convs that end with it.

    Sequences are sorted in runs of bounded size that carry common prefixes; ranges of all sequences, ties broken by conv, go to
    tasks, each of which merges its parts of the runs by a loser tree and gives up nodes as the merged stream leaves them. So copies of
    one conversation, or a first turn that many share, are spread over as many ranges as they fill. Only nodes on the first and last
    path of a range are put together afterwards. Sequences longer than ``stretch`` are cut; stretches are tries of their own, below the node
    that their head stands for, and are done from the last to the first: a round for each ``stretch`` turns of the longest sequence.
    A SHA-256 goes over its text in one task, in pieces; no other group is read by one task. No sequence, no row.
    """
    cut, top = stretches(rows, stretch)
    tails, out = None, []
    for level in range(top, -1, -1):
        mine = cut.where(F.col("level") == level).drop("level")
        full = F.size("keys") == stretch
        if tails is None:
            mine = mine.withColumn("tail", F.lit(None).cast("struct<children:bigint,leaves:bigint,saved:bigint,ends:string>"))
        else:
            mine = mine.join(tails, F.when(full, F.col("next")) == F.col("__head"), "left").drop("__head")
        nodes, roots = _level(mine)
        nodes, _ = written(nodes.withColumn("depth", F.col("depth") + level * stretch).where((F.col("depth") > level * stretch) | F.lit(level == 0)), "trie")
        out.append(nodes)
        tails = roots.select(F.col("head").alias("__head"), F.struct(F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), "ends").alias("tail"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    placed, _ = written(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(rebuilt(placed))


#: The same in DuckDB's SQL, for tables in which no two turns of a conversation tie.
SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS n, c - c % {FAMILY} AS base, {CRC32.format("CAST(c AS VARCHAR)")} % {TAKEN} AS h FROM t GROUP BY c),
f AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS taken FROM s LEFT JOIN s b ON b.c = s.base),
turns AS (SELECT f.c, taken + pos - h AS pos, r, x FROM t JOIN f USING (c) WHERE pos >= h UNION ALL SELECT f.c, t.pos, r, x FROM f JOIN t ON t.c = f.base WHERE t.pos < f.h),
chain AS (SELECT c, pos + 1 AS depth, strlen(x) AS bytes, md5(string_agg(md5(concat(strlen(r), ':', r, x)), '') OVER (PARTITION BY c ORDER BY pos)) AS id FROM turns UNION ALL SELECT c, 0, 0, 'root' FROM f),
path AS (SELECT *, lag(id) OVER w AS parent, lead(id) OVER w IS NULL AS last FROM chain WINDOW w AS (PARTITION BY c ORDER BY depth)),
node AS (SELECT id, any_value(depth) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM path GROUP BY id),
kids AS (SELECT parent AS id, count(*) AS k FROM node WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.id, b.id AS under FROM path a JOIN path b ON a.c = b.c AND b.depth >= a.depth),
total AS (SELECT below.id, sum((u.n - 1) * u.bytes) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves FROM below JOIN node u ON u.id = below.under LEFT JOIN kids ON kids.id = u.id GROUP BY below.id)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.k, 0) AS n_children, total.leaves AS n_leaves, CAST(total.saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN total USING (id) LEFT JOIN kids USING (id) LEFT JOIN node up ON up.id = node.parent
"""
