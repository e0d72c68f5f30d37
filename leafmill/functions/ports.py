"""Ports for models that run outside the engine: speech, language, vision and picture models.

The engine plans around them; a port is a plain function that tasks call in batches, with retries. The doubles here are
deterministic and serve tests and estimates.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import text as T

SCENES = "scenes array<struct<title:string,bullets:array<string>,narration:string>>"


class PortError(RuntimeError):
    """[H6] A model that failed after all attempts."""


def with_retry(call: Callable, *args, attempts: int = 3, pause: float = 1.5, sleep: Callable[[float], None] = time.sleep):
    """[D3] The call's result; after a failure or an empty result it is tried again, later each time."""
    last: Exception | None = None
    for k in range(1, attempts + 1):
        try:
            result = call(*args)
            if result:
                return result
            last = PortError("empty output")
        except Exception as e:  # any failure of a foreign model counts as an attempt
            last = e
        if k < attempts:
            sleep(pause * k)
    raise PortError(f"failed {attempts} times: {last}") from last


def silent_speech(text: str) -> float:
    """[D1, S16] A speech double: two and a half words a second, half a second at least."""
    return max(0.5, len(text.split()) / 2.5)


def speech_seconds(engine: Callable[[str], float] = silent_speech) -> Callable[[Column], Column]:
    """[D1, B5] A column function from text to seconds by a speech engine."""

    @F.pandas_udf("double")
    def seconds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else float(with_retry(engine, t)))

    return seconds


def apply_port(df: DataFrame, port: Callable[..., str], inputs: list[str], output: str, attempts: int = 2) -> DataFrame:
    """[D5, D6, D7] ``df`` with a text column from a port, called with the input columns; null if all attempts fail.

    Rows go to tasks as they are partitioned, so a model loads once a task; identical inputs should be made
    distinct before.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{output}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch[inputs].itertuples(index=False):
                try:
                    out.append(with_retry(port, *row, attempts=attempts, pause=0))
                except PortError:
                    out.append(None)
            yield batch.assign(**{output: pd.Series(out, index=batch.index, dtype=object)})

    return df.mapInPandas(run, schema)


def answered_scenes(answer: Column) -> Column:
    """[F12, B2] Scenes of a model's JSON: those with narration, four bullets that are not blank; null if none is left."""
    scene = lambda s: F.struct(
        T.strip(F.coalesce(s["title"], F.lit(""))).alias("title"),
        F.slice(F.array_remove(F.transform(F.coalesce(s["bullets"], F.array().cast("array<string>")), lambda b: T.strip(F.coalesce(b, F.lit("")))), ""), 1, C.MAX_BULLETS).alias("bullets"),
        T.strip(s["narration"]).alias("narration"),
    )
    parsed = F.from_json(answer, SCENES)["scenes"]
    kept = F.filter(F.transform(parsed, scene), lambda s: F.coalesce(s["narration"], F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept)


def scenes_or_fallback(sections: DataFrame, extractive: Column, mode: str = "auto") -> DataFrame:
    """[B1, B2] Scenes and source of each chapter: the model's, or extractive ones where a segment failed.

    ``sections``: (doc_id, number, segment_no, answer, ...) with one row a segment and the chapter's ``paragraphs`` and
    ``title``; in mode ``ai`` a failure raises.
    """
    rows = sections.withColumn("__s", answered_scenes(F.col("answer")))
    grouped = rows.groupBy("doc_id", "number").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment_no", "__s"))), lambda x: x["__s"])).alias("ai"), F.bool_and(F.col("__s").isNotNull()).alias("ok"),
        F.first("title").alias("title"), F.first("paragraphs").alias("paragraphs"),
    )
    failed = F.raise_error(F.lit("the model's script failed")).cast("array<struct<title:string,bullets:array<string>,narration:string>>") if mode == "ai" else extractive
    use_ai = F.col("ok") if mode != "extractive" else F.lit(False)
    return grouped.select("doc_id", "number", F.when(use_ai, F.col("ai")).otherwise(failed).alias("scenes"), F.when(use_ai, "ai").otherwise("extractive").alias("source"))


def scene_prompt(doc_title: Column, chapter: Column, segment: Column, k: Column, n: Column) -> Column:
    """[P14] What a language model is asked about the k-th of n segments."""
    where = F.when(n > 1, F.format_string("\nThis is part %d of %d of the chapter.", k, n)).otherwise("")
    return F.concat(F.lit("Document: "), doc_title, F.lit("\nChapter: "), chapter, where, F.lit("\n\n"), segment)
