"""Physical plans: what is row-local neither shuffles nor runs Python, and scans read the columns they need."""

import re

import pytest

from leafmill.plans import catalog

SF = "/root/testdata/sf0.001"
ROW_LOCAL = ("doc_info", "paragraphs", "sentences", "sentence_stats", "chunks_900", "segments_20k", "parts_plan", "subtitle_cues", "srt_cues", "extractive_scenes", "heading_lines", "parts_estimate")


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local(spark, name):
    found = plan(spark, name)
    assert not re.search("Exchange|Python|Pandas|Arrow|Join", found)
    columns = re.search(r"ReadSchema: struct<([^>]*)>", found)[1]
    assert {c.split(":")[0] for c in columns.split(",")} <= {"doc_id", "text"}


@pytest.mark.parametrize("name", ["language_confusion", "selected_summary", "body_size"])
def test_sums_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


def test_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    found = catalog.queries()["doc_info"](spark, SF).where(F.col("doc_id") == 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in found


def test_nothing_is_joined_by_nested_loops(spark):
    for name in ("running_headers", "mentioned_figures", "nearest_caption", "outline_chapters", "selected_chapters", "voice_outer_join"):
        assert not re.search("NestedLoop|Cartesian", plan(spark, name)), name
