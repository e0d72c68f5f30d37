"""Answers of language models: whole, cut or malformed JSON, the first field that breaks what was asked for, and the scenes that can be kept."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
#: What may stand at the end of a text that was cut within a string, a number or a word.
_OPEN_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*(?:\\(?:u[0-9A-Fa-f]{0,3})?)?\Z')
_OPEN_SCALAR = re.compile(r"(?:-|-?(?:0|[1-9]\d*)(?:\.|(?:\.\d+)?[eE][+-]?)|t|tr|tru|f|fa|fal|fals|n|nu|nul)\Z")
WHOLE, CUT, MALFORMED = "whole", "cut", "malformed"


def scan(text: str) -> tuple[str, list[int]]:
    """Whether a text is whole, cut or malformed JSON, and where its outermost list items of depth 2 end.

    A pushdown automaton: one pass, a stack of what is open. A text is cut if more text could make it whole.
    """
    at, stack, ends = 0, [], []
    wanted = "value"  # value, first (of a list), key, name (behind a comma), colon, next, end
    while True:
        at = _SPACE.match(text, at).end()
        if at == len(text):
            return (WHOLE if wanted == "end" else CUT), ends
        c = text[at]
        if wanted == "end":
            return MALFORMED, ends
        if wanted == "colon":
            if c != ":":
                return MALFORMED, ends
            at, wanted = at + 1, "value"
            continue
        if wanted == "next" or (c in "]}" and wanted in ("first", "key")):
            if c == "," and wanted == "next":
                at, wanted = at + 1, "value" if stack[-1] == "[" else "name"
            elif stack and c == {"[": "]", "{": "}"}[stack[-1]]:
                stack.pop()
                at += 1
                if stack == ["{", "["]:
                    ends.append(at)
                wanted = "next" if stack else "end"
            else:
                return MALFORMED, ends
            continue
        if wanted in ("key", "name"):
            m = _STRING.match(text, at)
            if not m:
                return (CUT if _OPEN_STRING.match(text, at) else MALFORMED), ends
            at, wanted = m.end(), "colon"
            continue
        if c in "[{":
            stack.append(c)
            at, wanted = at + 1, "first" if c == "[" else "key"
            continue
        m = _STRING.match(text, at) if c == '"' else _SCALAR.match(text, at)
        if c != '"' and _OPEN_SCALAR.match(text, at):
            return CUT, ends
        if not m:
            return (CUT if c == '"' and _OPEN_STRING.match(text, at) else MALFORMED), ends
        if c != '"' and m.end() < len(text) and text[m.end()] not in " \t\n\r,]}":
            return MALFORMED, ends
        at, wanted = m.end(), "next" if stack else "end"


#: What is asked for: a type, a tuple of allowed words, a list of one shape, or fields; a field whose name ends in ``?`` may be null.
ITEM = {"label": str}
DIAGRAM = {"type": ("flow", "cycle", "hierarchy", "hub", "comparison", "timeline", "bars"), "items": [ITEM]}
ILLUSTRATION = {"kind": ("diagram", "picture"), "placement": ("right", "left", "full"), "animation": ("none", "fade_in", "reveal", "zoom_in", "zoom_out", "pan"), "prompt": str, "diagram?": DIAGRAM}
SCENE = {"title": str, "bullets": [str], "narration": str}
SCENES = {"scenes": [SCENE]}
ILLUSTRATED_SCENES = {"scenes": [SCENE | {"illustration?": ILLUSTRATION}]}
CHOICES = {"choices": [{"scene": int, "book_image?": int, "reason": str}]}


def fault(value: object, shape: object, path: str = "$") -> str | None:
    """The path of the first field, in the order of the shape, that is not as asked for; null if all are."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return path
        for name, inner in shape.items():
            key = name.removesuffix("?")
            if key not in value:
                return f"{path}.{key}"
            if not (name.endswith("?") and value[key] is None) and (found := fault(value[key], inner, f"{path}.{key}")):
                return found
        return None
    if isinstance(shape, list):
        if not isinstance(value, list):
            return path
        return next((found for k, x in enumerate(value) if (found := fault(x, shape[0], f"{path}[{k}]"))), None)
    if isinstance(shape, tuple):
        return None if value in shape else path
    return None if isinstance(value, shape) and not isinstance(value, bool) else path


def judged(shape: dict) -> Callable[[Column], Column]:
    """[H11] A column function: struct(verdict, fault) of an answer; null for null.

    ``fault`` names the first field of a whole answer that breaks ``shape``; numbers that JSON has not, and keys that
    repeat, are as the parser takes them.
    """

    @F.pandas_udf("verdict string, fault string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            verdict = scan(text)[0] if text is not None else None
            rows.append((verdict, fault(json.loads(text), shape) if verdict == WHOLE else None))
        return pd.DataFrame(rows, columns=["verdict", "fault"])

    return judge


def mended(answer: Column) -> Column:
    """[B2] A cut answer closed behind its last whole item, so that what was answered in full can be read; other answers as they are."""

    @F.pandas_udf("string")
    def mend(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            verdict, ends = scan(text)
            return text[: ends[-1]] + "]}" if verdict == CUT and ends else text

        return texts.map(one)

    return mend(answer)


def request(document: Column, chapter: Column, segment: Column, k: Column, n: Column) -> Column:
    """[P14] What is asked about the k-th of n segments of a chapter, with what the part has to do."""
    first = F.when(k == 1, "Open with what the chapter is about.").otherwise("Go on with the explanation; the chapter is known already.")
    last = F.when(k == n, " Close with a short summary of the chapter.").otherwise("")
    part = F.when(n == 1, "The text is the whole chapter. Open with its subject and close with a short summary.").otherwise(F.concat(F.format_string("The text is part %d of %d of the chapter. ", k, n), first, last))
    return F.concat(F.lit("Document: "), document, F.lit("\nChapter: "), chapter, F.lit("\n"), part, F.lit("\n\n<text>\n"), segment, F.lit("\n</text>\n\nAnswer with the script of the explanation as JSON."))
