"""Folds over rows: texts whose lines, paragraphs or chunks are rows, of any length, in place of arrays in one row.

The functions of :mod:`leafmill.operators.segmentation` fold the array of one row; these give the same for texts that stand in many
rows. First it is found where something begins, from lengths alone, and then texts move once, in blocks of neighbours, and are put
together where they stand; only what goes on from block to block meets again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import segmentation as seg
from leafmill.operators.running import group_key, running_totals
from leafmill.scratch import remove, written

State = tuple
#: Lines or paragraphs of a block.
BLOCK = 256
#: Rows of a batch whose values are Python objects at a time.
AT_ONCE = 1024


def carried(rows: DataFrame, group: list[str], order: list[Column], inputs: list[str], start: State, step: Callable[[State, tuple], tuple[State, float | list]], name: str, kind: str = "int") -> DataFrame:
    """``rows`` with the column ``name``, an int, a double or a list of ints: what ``step`` says of each row, from the state before it and the row's ``inputs``.

    ``step`` gives the next state, a small tuple, and the row's result; each group begins with ``start``. Rows are dealt
    to range partitions by group and order and folded where they stand, with the state that the partition before leaves when the
    group goes on. Those states are not known at first: each partition begins with ``start``, and as long as one has begun with
    another state than its predecessor ends with, all are folded again. Folds that pack things forget where they began,
    so as a rule the second round is the last one; it never takes more rounds than partitions that a group spans, plus one.
    Only ``inputs`` are read in a round, and the driver sees one state a partition. Rows that tie in ``order`` must be equal.
    """
    own = [c for c in rows.columns if c != name]
    by = [*[F.col(c).asc_nulls_first() for c in group], *order]
    dealt = rows.select(*own, group_key(group).alias("__g")).repartitionByRange(*by).sortWithinPartitions(*by)
    placed, _ = written(dealt.withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id()}), "fold")
    narrow, path = written(placed.select("__part", "__n", "__g", *inputs), "steps")
    groups = {r["__part"]: (r.first, r.last) for r in narrow.groupBy("__part").agg(F.min_by("__g", "__n").alias("first"), F.max_by("__g", "__n").alias("last")).collect()}  # a row a partition
    parts = sorted(groups)
    begun: dict[int, State] = dict.fromkeys(parts, start)
    while True:
        folded, folded_path = written(_folded(narrow, inputs, begun, start, step, name, kind), "folded")
        ends = {r["__part"]: tuple(r.state) for r in folded.where("state is not null").select("__part", F.from_json("state", "array<double>").alias("state")).collect()}
        follows = {p: ends[q] if groups[q][1] == groups[p][0] else start for q, p in zip(parts, parts[1:], strict=False)}
        wrong = {p: s for p, s in follows.items() if tuple(map(float, begun[p])) != tuple(map(float, s))}
        if not wrong:
            break
        begun |= wrong
        remove(rows.sparkSession, folded_path)
    remove(rows.sparkSession, path)
    found = folded.where("state is null").select(F.col("__n").alias("__m"), name)
    return placed.join(found, F.col("__n") == F.col("__m")).select(*own, name)


def _folded(narrow: DataFrame, inputs: list[str], begun: dict[int, State], start: State, step: Callable, name: str, kind: str) -> DataFrame:
    """(part, n, result, null) of every row, and (part, null, null, state) of each partition's end."""
    number = {"int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}[kind]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, state = None, None, start
        for batch in (b.slice(k, AT_ONCE) for b in it for k in range(0, b.num_rows, AT_ONCE)):
            ends: list[tuple] = []
            results = []
            for p, g, *values in zip(*(batch.column(k).to_pylist() for k in (0, 2, *range(3, 3 + len(inputs)))), strict=True):
                if p != part:
                    if part is not None:
                        ends.append((part, state))
                    part, group, state = p, g, begun[p]
                elif g != group:
                    group, state = g, start
                state, result = step(state, tuple(values))
                results.append(result)
            n = len(ends)
            columns = [pa.array([*batch.column(0).to_pylist(), *(p for p, _ in ends)], pa.int32()), pa.array([*batch.column(1).to_pylist(), *[None] * n], pa.int64()), pa.array([*results, *[None] * n], number)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([*[None] * len(results), *(_json(s) for _, s in ends)], pa.string())], ["__part", "__n", name, "state"])
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([None], number), pa.array([_json(state)], pa.string())], ["__part", "__n", name, "state"])

    return narrow.repartition("__part").sortWithinPartitions("__part", "__n").mapInArrow(batches, f"__part int, __n long, `{name}` {kind}, state string")


def _json(state: State) -> str:
    return "[" + ",".join(repr(float(x)) for x in state) + "]"


def _block(number: str) -> Column:
    return F.floor(F.col(number) / BLOCK).cast("long").alias("block")


def _together(*tables: tuple[DataFrame, str, Column, bool]) -> DataFrame:
    """(doc_id, block, ...) with a column of each table (rows, name, value, listed): its values in order, or the only one. All meet in one shuffle; null documents are documents."""
    kinds = [(name, rows.select(value.alias(name)).schema[name].dataType.simpleString()) for rows, name, value, _ in tables]
    parts = [rows.select("doc_id", "block", *[(value if n == name else F.lit(None).cast(kind)).alias(n) for n, kind in kinds]) for rows, name, value, _ in tables]
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "block").agg(*[(F.array_sort(F.collect_list(n)) if listed else F.first(n, ignorenulls=True)).alias(n) for _, n, _, listed in tables])


def _around() -> tuple[WindowSpec, WindowSpec]:
    """The blocks of a document before a block and behind it; rows of a few numbers, one for ``BLOCK`` lines or paragraphs."""
    of_doc = Window.partitionBy("doc_id").orderBy(F.col("block").asc_nulls_first())
    return of_doc.rowsBetween(Window.unboundedPreceding, -1), of_doc.rowsBetween(1, Window.unboundedFollowing)


def _typical(lengths: DataFrame) -> DataFrame:
    """(doc, typical) of (doc_id, chars): the length at 0.8 of a document's lengths in order. A text of n characters has no more than some root of 2n lengths of line."""
    counts = lengths.groupBy("doc_id", "chars").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chars", "n"))).alias("c"), F.sum("n").alias("total"))

    def step(s: Column, x: Column) -> Column:
        upto = s["upto"] + x["n"]
        found = F.when(s["found"].isNull() & (upto > F.floor(F.col("total") * F.lit(0.8))), x["chars"]).otherwise(s["found"])
        return F.struct(upto.alias("upto"), found.alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("found"))
    return counts.select(F.col("doc_id").alias("__doc"), F.aggregate("c", start, step, lambda s: s["found"]).alias("typical"))


def _sized(raw: Column) -> Column:
    """(line, chars, size) of a line: size is -2 for what is no part of a paragraph, -1 for what cannot end one, else the length that tells if it ends one."""
    size = lambda x: F.when(T.is_page_number(x), -2).when(F.substring(x, -1, 1).isin(*'.!?:…"”'), F.length(x)).otherwise(-1)
    of = lambda x: F.struct(x.alias("line"), F.coalesce(F.length(raw), F.lit(-1)).alias("chars"), F.when(F.length(x) > 0, size(x)).otherwise(-2).alias("size"))
    return T.let(T.strip(raw), of)


def _cut(x: Column, typical: Column) -> Column:
    """A paragraph ends with the line: it is blank, or short and ends like a sentence."""
    return (x["chars"] == 0) | ((x["size"] >= 0) & (x["size"] < typical * F.lit(0.75)))


def line_paragraphs(lines: DataFrame) -> DataFrame:
    """[P1, P2] (doc_id, para_no, text): the paragraphs of documents whose lines are rows (doc_id, line_no, text), as ``segmentation.paragraphs`` gives them.

    The typical length of a document's lines, and what is open where a block of lines begins, come from lengths
    alone, so ``lines`` is read twice. Texts move once, into blocks; a paragraph that goes on from block to
    block is put together from its lines there. Line numbers are whole numbers.
    """
    clean = lines.select("doc_id", _block("line_no"), "line_no", T.rstrip(T.normalize(F.col("text"), False)).alias("raw"))
    sizes = clean.select("doc_id", "block", "line_no", _sized(F.col("raw")).alias("x")).select("doc_id", "block", F.struct("line_no", "x.chars", "x.size").alias("x"))
    sizes = sizes.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("x")).alias("l"))
    sizes, _ = written(sizes.select("doc_id", "block", F.transform("l", lambda x: F.struct(x["chars"].alias("chars"), x["size"].alias("size"))).alias("l")), "lines")
    typical = _typical(sizes.select("doc_id", F.explode(F.filter(F.transform("l", lambda x: x["chars"]), lambda c: c > 0)).alias("chars")))
    known = sizes.join(typical, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").withColumn("typical", F.coalesce("typical", F.lit(0)))

    def follow(s: Column, x: Column) -> Column:
        kept, cut = x["size"] > -2, _cut(x, F.col("typical"))
        opened = s["opened"] + F.when(kept & ~s["open"], 1).otherwise(0)
        return F.struct((~cut & (kept | s["open"])).alias("open"), opened.alias("opened"), (s["cut"] | cut).alias("cut"), (s["head"] | (kept & ~s["cut"])).alias("head"))

    no, (before, behind) = F.lit(False), _around()
    start = F.struct(no.alias("open"), F.lit(0).alias("opened"), no.alias("cut"), no.alias("head"))
    passed = known.select("doc_id", "block", "typical", F.aggregate("l", start, follow).alias("s"))
    passed = passed.withColumn("open", F.coalesce(F.last(F.when(F.col("s.cut") | F.col("s.head"), F.col("s.open")), ignorenulls=True).over(before), no))
    passed = passed.withColumn("opened", F.col("s.opened") - F.when(F.col("open") & F.col("s.head"), 1).otherwise(0))
    passed = passed.select("doc_id", "block", F.struct("typical", "open", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("first"), (F.count(F.lit(1)).over(behind) > 0).alias("more")).alias("i"))

    def joined(l: Column) -> Column:  # noqa: E741
        glued = lambda i: F.coalesce(F.get(l, i - 1).endswith("-") & F.get(l, i).rlike(r"^\p{Ll}"), F.lit(False))
        piece = lambda x, i: F.concat(F.when((i == 0) | glued(i), "").otherwise(" "), F.when(glued(i + 1), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
        return F.array_join(F.transform(l, piece), "")

    def pieces(l: Column) -> Column:  # noqa: E741
        """(para_no, shared, lines) of the block's paragraphs; shared: it may have lines in other blocks."""
        stops = F.concat(F.filter(F.sequence(F.lit(0), F.size(l) - 1), lambda i: F.get(l, i)["cut"]), F.array(F.size(l)))
        of = lambda a, z: F.transform(F.filter(F.slice(l, a + 1, z - a + 1), lambda x: x["kept"]), lambda x: x["line"])
        run = lambda s: lambda z, k: F.struct((k == 0).alias("head"), (k == F.size(s) - 1).alias("tail"), of(F.coalesce(F.get(s, k - 1) + 1, F.lit(0)), z).alias("lines"))
        runs = F.filter(T.let(stops, lambda s: F.transform(s, run(s))), lambda r: F.size(r["lines"]) > 0)
        shared = lambda r: (r["head"] & F.col("i.open")) | (r["tail"] & F.col("i.more"))
        number = lambda r, k: F.col("i.first") + k - F.when(F.get(r, F.lit(0))["head"] & F.col("i.open"), 1).otherwise(0)
        return T.let(runs, lambda r: F.transform(r, lambda x, k: F.struct(number(r, k).cast("int").alias("para_no"), shared(x).alias("shared"), x["lines"].alias("lines"))))

    met = _together((clean, "l", F.struct("line_no", "raw"), True), (passed, "i", F.col("i"), False))
    marked = F.transform("l", lambda x: T.let(_sized(x["raw"]), lambda y: F.struct(y["line"].alias("line"), _cut(y, F.col("i.typical")).alias("cut"), (y["size"] > -2).alias("kept"))))
    found = lambda rows: rows.select("doc_id", "block", F.inline(T.let(marked, pieces)))
    parts = found(met.where("i.open or i.more")).where("shared").groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list(F.struct("block", "lines"))).alias("l"))
    whole = found(met).where("not shared").select("doc_id", "para_no", "lines").unionByName(parts.select("doc_id", "para_no", F.flatten(F.transform("l", lambda x: x["lines"])).alias("lines")))
    return whole.select("doc_id", "para_no", T.clean_paragraph(T.let(F.col("lines"), joined), False).alias("text"))


def _packing(most: int) -> Callable[[State, tuple], tuple[State, int]]:
    """The fold of ``segmentation.chunks`` on lengths: 0 if a unit goes on, 1 if it begins a chunk behind a paragraph's end, 2 if within a paragraph."""

    def step(state: State, row: tuple) -> tuple[State, int]:
        held, (size, whole, first) = state[0], row
        fits = held + size + 1 <= most
        if whole and fits:
            return (held + 1 + size if held else size,), 0 if held else 1
        if whole or first:
            return (size,), 1
        if held and not fits:
            return (size,), 2
        return (held + 1 + size if held else size,), 0 if held else 1

    return step


def row_chunks(paras: DataFrame, most: int = 1500) -> DataFrame:
    """[P4, P5, P7] (doc_id, chunk_no, text, ends_paragraph): the chunks of documents whose paragraphs are rows (doc_id, para_no, text), as ``segmentation.chunks`` gives them.

    Units are found once, within each paragraph, and chunks begin where a fold over their lengths says, a row a block. Then
    paragraphs move once, into their blocks, and only the pieces of a chunk that goes on from block to block, at most ``most``
    characters, meet again. Paragraph numbers are whole numbers.
    """
    paras, _ = written(paras.select("doc_id", _block("para_no"), "para_no", seg.units(F.array(F.coalesce("text", F.lit(""))), most).alias("units")), "units")
    packed = F.transform("units", lambda u: F.length(u["text"]) * 4 + u["whole"].cast("int") * 2 + u["first"].cast("int"))
    sizes = paras.select("doc_id", "block", F.struct("para_no", packed.alias("u")).alias("x")).groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("x")).alias("l"))
    step = _packing(most)

    def steps(state: State, row: tuple) -> tuple[State, list[int]]:
        out = []
        for x in row[0]:
            state, begins = step(state, (x >> 2, bool(x & 2), bool(x & 1)))
            out.append(begins)
        return state, out

    begun = carried(sizes.select("doc_id", "block", F.flatten(F.transform("l", lambda x: x["u"])).alias("u")), ["doc_id"], [F.col("block").asc_nulls_first()], ["u"], (0,), steps, "b", "array<int>").select("doc_id", "block", "b")
    codes, (before, behind) = F.filter("b", lambda x: x > 0), _around()
    counts = begun.select("doc_id", "block", F.size(codes).alias("n"), F.get(codes, F.lit(0)).alias("code"))
    counts = counts.select("doc_id", "block", F.struct(F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.first("code", ignorenulls=True).over(behind).alias("next"), (F.count(F.lit(1)).over(behind) > 0).alias("more")).alias("i"))

    def pieces(u: Column) -> Column:
        """(chunk_no, shared, text, ends_paragraph) of the block's chunks; shared: it may have units in other blocks."""
        b, goes_on = F.col("b"), F.get("b", F.lit(0)) == 0
        starts = F.filter(F.sequence(F.lit(0), F.size(u) - 1), lambda i: (i == 0) | (F.get(b, i) > 0))
        join = lambda a: lambda x, i: F.concat(F.when((i == 0) & (F.get(b, a) > 0), "").when(x["whole"], "\n").otherwise(" "), x["text"])
        text = lambda a, z: F.array_join(F.transform(F.slice(u, a + 1, z - a), join(a)), "")
        code = lambda s, k: F.when(k == F.size(s) - 1, F.col("i.next")).otherwise(F.get(b, F.get(s, k + 1)))

        def run(s: Column) -> Callable[[Column, Column], Column]:
            return lambda a, k: F.struct(
                (F.col("i.first") + k - F.when(goes_on, 1).otherwise(0)).cast("int").alias("chunk_no"), (((k == 0) & goes_on) | ((k == F.size(s) - 1) & F.col("i.more"))).alias("shared"),
                text(a, F.coalesce(F.get(s, k + 1), F.size(u))).alias("text"), F.coalesce(code(s, k) != 2, F.lit(True)).alias("ends_paragraph"),
            )

        return F.when(F.size(u) > 0, T.let(starts, lambda s: F.transform(s, run(s))))

    met = _together((paras, "l", F.struct("para_no", "units"), True), (begun, "b", F.col("b"), False), (counts, "i", F.col("i"), False))
    found = lambda rows: rows.select("doc_id", "block", F.inline(T.let(F.flatten(F.transform("l", lambda x: x["units"])), pieces)))
    parts = found(met.where("i.more or b[0] = 0")).where("shared").groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("block", "text", "ends_paragraph"))).alias("l"))
    parts = parts.select("doc_id", "chunk_no", F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"), F.element_at("l", -1)["ends_paragraph"].alias("ends_paragraph"))
    return found(met).where("not shared").select(parts.columns).unionByName(parts).select("doc_id", "chunk_no", T.strip(F.col("text")).alias("text"), "ends_paragraph")


def _parting(most: float) -> Callable[[State, tuple], tuple[State, int]]:
    """The fold of ``segmentation.plan_parts``: 1 if a part begins with the row."""
    aim = lambda rest: rest / math.ceil(rest / most) if rest > most else rest

    def step(state: State, row: tuple) -> tuple[State, int]:
        rest, target, elapsed, ended, empty = state
        seconds, ends, total = row
        if empty:
            rest, target = total, aim(total)
        over, under = elapsed + seconds - target, target - elapsed
        if not empty and total > most and (elapsed + seconds > most or (over > 0 and under < (2.0 if ended else 1.0) * over)):
            rest -= elapsed
            return (rest, aim(rest), seconds, float(ends), 0.0), 1
        return (rest, target, elapsed + seconds, float(ends), 0.0), int(bool(empty))

    return step


def row_parts(items: DataFrame, order: str, most: float) -> DataFrame:
    """[W1] ``items`` (doc_id, order, seconds, ends, ...) with ``part_no`` from 0, as ``segmentation.plan_parts`` gives it for the arrays of a document.

    A document's seconds are added up in its order, as the array's are: another order can end in another last bit, and so in other parts.
    """
    upto = carried(items.select("doc_id", order, "seconds"), ["doc_id"], [F.col(order).asc()], ["seconds"], (0.0,), lambda s, r: ((s[0] + r[0],), s[0] + r[0]), "__upto", "double")
    total = upto.groupBy(F.col("doc_id").alias("__doc")).agg(F.max_by("__upto", order).alias("__total"))
    rows = items.join(total, F.col("doc_id") == F.col("__doc")).drop("__doc")
    begun = carried(rows, ["doc_id"], [F.col(order).asc()], ["seconds", "ends", "__total"], (0.0, 0.0, 0.0, 0.0, 1.0), _parting(float(most)), "__begins").drop("__total")
    return running_totals(begun, ["doc_id"], [F.col(order).asc()], {"part_no": F.col("__begins")}).withColumn("part_no", (F.col("part_no") - 1).cast("int")).drop("__begins")
