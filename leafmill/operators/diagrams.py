"""Where the items of a diagram go: rectangles by layout, as arithmetic over item ordinals [D8, R4-R12]."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAYOUTS = ("flow", "cycle", "hierarchy", "hub", "comparison", "timeline", "bars")
GAP, CAPTION_BAND, WIDE, LEAST_CHILD, LEAST_BAR = 40.0, 56.0, 1.5, 170.0, 6.0
PALETTE = 7


def _rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(("x", "y", "w", "h"), (x, y, w, h), strict=True)])


def _line(k: Column, n: Column, width: Column, height: Column, across: Column) -> Column:
    """The k-th of n equal boxes in a row or a column."""
    w, h = (width - GAP * (n - 1)) / n, (height - GAP * (n - 1)) / n
    return F.when(across, _rect(k * (w + GAP), F.lit(0), w, height)).otherwise(_rect(F.lit(0), k * (h + GAP), width, h))


def _ring(k: Column, n: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """The k-th of n boxes on an ellipse, the first on top."""
    angle = F.lit(-math.pi / 2) + 2 * math.pi * k / n
    return _rect((width - w) / 2 * (1 + F.cos(angle)), (height - h) / 2 * (1 + F.sin(angle)), w, h)


def item_boxes(items: DataFrame, width: float, height: float) -> DataFrame:
    """(diagram_id, item_no, box, color) from (diagram_id, type, item_no, value, captioned); item_no from 0.

    A caption takes 56 pixels off the height. Flows and timelines lie across where the space is one and a half times as
    wide as high; a hierarchy is a tree while its children are 170 pixels wide, else a list; a hub's and a hierarchy's
    first item is the centre or root; bars scale to the largest value, 6 pixels at least; colours repeat after seven.
    """
    whole = Window.partitionBy("diagram_id")
    rows = items.withColumn("__n", F.count("*").over(whole)).withColumn("__most", F.max("value").over(whole))
    k, n = F.col("item_no"), F.col("__n")
    w, h = F.lit(float(width)), F.lit(float(height)) - F.when(F.col("captioned"), CAPTION_BAND).otherwise(0.0)
    across = w / h >= WIDE
    kids = F.greatest(F.lit(1), n - 1)
    child = (w - GAP * (kids - 1)) / kids
    tree = F.when(k == 0, _rect(w / 4, F.lit(0), w / 2, h * 0.35)).otherwise(_rect((k - 1) * (child + GAP), h * 0.6, child, h * 0.4))
    row_h = (h - GAP / 2 * (n - 1)) / n
    listed = _rect(F.when(k == 0, 0.0).otherwise(GAP), k * (row_h + GAP / 2), w - F.when(k == 0, 0.0).otherwise(GAP), row_h)
    hub = F.when(k == 0, _rect(w * 0.37, h * 0.37, w * 0.26, h * 0.26)).otherwise(_ring(k - 1, kids, w, h, w * 0.26, h * 0.22))
    scale = F.when(F.coalesce("__most", F.lit(0.0)) == 0, 1.0).otherwise(F.col("__most"))
    bar = _rect(F.lit(0), k * (row_h + GAP / 2), F.greatest(F.lit(LEAST_BAR), w * F.col("value") / scale), row_h)
    kind = F.col("type")
    box = (
        F.when(kind.isin("flow", "timeline"), _line(k, n, w, h, across)).when(kind == "comparison", _line(k, n, w, h, F.lit(True))).when(kind == "cycle", _ring(k, n, w, h, w * 0.28, h * 0.24))
        .when(kind == "hub", hub).when(kind == "hierarchy", F.when(child >= LEAST_CHILD, tree).otherwise(listed)).when(kind == "bars", bar)
    )
    return rows.select("diagram_id", "item_no", box.alias("box"), (k % PALETTE).cast("int").alias("color"))


def placement_box(placement: Column, width: int = 1920, height: int = 1080) -> Column:
    """[X22] Where an illustration goes on a slide: right, left or all of it."""
    half = lambda x: _rect(F.lit(x), F.lit(200), F.lit(width // 2 - 120), F.lit(height - 320))
    return F.when(placement == "full", _rect(F.lit(80), F.lit(200), F.lit(width - 160), F.lit(height - 320))).when(placement == "left", half(80)).otherwise(half(width // 2 + 40))


def slide_timing(kind: Column, animation: Column, items: Column, has_image: Column) -> Column:
    """[R13, R14] How a slide plays: reveal, fade, motion or still."""
    return (
        F.when((kind == "diagram") & (animation == "reveal") & (items > 1), "reveal")
        .when((kind == "picture") & has_image & animation.isin("zoom_in", "zoom_out", "pan"), "motion")
        .when(animation == "fade_in", "fade")
        .otherwise("still")
    )
