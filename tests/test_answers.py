import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import answers as A


def verdict(text):
    """By the library's parser: whole if it parses, cut if some ending makes it parse."""
    try:
        json.loads(text, parse_constant=lambda c: 1 / 0)
        return A.WHOLE
    except (ValueError, ZeroDivisionError):
        pass
    return None


DOCS = [{"scenes": [{"title": 'a "quoted" \\ é\n', "bullets": ["x", "y"], "narration": "n"}, {"title": "", "bullets": [], "narration": None}]}, [], {}, [1, -2.5e-3, True, False, None, "uሴ"], "s", 0, {"a": {"b": [[{}], [[]]]}}]


@pytest.mark.parametrize("value", DOCS)
@pytest.mark.parametrize("indent", [None, 2])
def test_cut_at_every_length(value, indent):
    for ascii_only in (True, False):
        text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
        assert A.scan(text)[0] == A.scan(text + " \n")[0] == A.WHOLE
        for k in range(len(text)):
            want = verdict(text[:k]) or A.CUT  # 0 of 0.5 is whole by itself
            assert A.scan(text[:k])[0] == want, text[:k]


def test_no_broken_text_passes():
    """Texts with a character changed: whole exactly where the library's parser takes them."""
    rng = random.Random(2)
    for _ in range(4000):
        text = json.dumps(rng.choice(DOCS))
        k = rng.randrange(len(text))
        text = text[:k] + rng.choice('{}[]",:01-.ae\\ \n') + text[k + rng.randint(0, 1) :]
        assert (A.scan(text)[0] == A.WHOLE) == (verdict(text) == A.WHOLE), text
    for text in ("]", "{]", "[1 2]", '{"a" 1}', "[,]", "[1,]", "{,}", '{"a":1,}', "tru e", "[01]", '"\n"', "[1]x", "nul l", '{1: 2}', "+1", "[1,,2]"):
        assert A.scan(text)[0] == A.MALFORMED, text


def test_first_field_at_fault():
    scene = {"title": "t", "bullets": ["b"], "narration": "n"}
    picture = {"kind": "picture", "placement": "left", "animation": "pan", "prompt": "p", "diagram": None}
    assert A.fault({"scenes": [scene]}, A.SCENES) is None and A.fault({"scenes": [scene | {"illustration": picture}, scene | {"illustration": None}]}, A.ILLUSTRATED_SCENES) is None
    for change, want in (({"title": 1}, "title"), ({"bullets": "b"}, "bullets"), ({"bullets": ["a", None]}, "bullets[1]"), ({"narration": None}, "narration")):
        assert A.fault({"scenes": [scene, scene | change]}, A.SCENES) == f"$.scenes[1].{want}"
    assert A.fault({"scenes": [scene]}, A.ILLUSTRATED_SCENES) == "$.scenes[0].illustration"
    assert A.fault({"scenes": [scene | {"illustration": picture | {"animation": "spin"}}]}, A.ILLUSTRATED_SCENES) == "$.scenes[0].illustration.animation"
    assert A.fault({"choices": [{"scene": True, "book_image": None, "reason": ""}]}, A.CHOICES) == "$.choices[0].scene" and A.fault([], A.SCENES) == "$"


def test_kept_scenes_of_cut_answers(spark):
    """For an answer cut at every length: the scenes that were answered in full."""
    whole = json.dumps({"scenes": [{"title": f"t{k}", "bullets": ["[{ ", " }]"], "narration": f"n {k}"} for k in range(4)]})
    ends = [i + 1 for i, c in enumerate(whole) if c == "}" and whole[i - 1] == '"']
    rows = spark.createDataFrame([(k, whole[:k]) for k in range(len(whole) + 1)] + [(-1, None)], "k int, answer string")
    read = F.from_json(A.mended(F.col("answer")), "scenes array<struct<title:string,narration:string>>")["scenes"]
    got = {r.k: (r.v, r.n) for r in rows.select("k", A.judged(A.SCENES)(F.col("answer"))["verdict"].alias("v"), F.size(F.filter(read, lambda s: s["narration"].isNotNull())).alias("n")).collect()}
    for k in range(len(whole)):
        assert got[k][0] == "cut" and (got[k][1] or 0) in (sum(e <= k for e in ends), -1, 0)
        if k >= ends[0]:
            assert got[k][1] == sum(e <= k for e in ends)
    assert got[len(whole)] == ("whole", 4) and got[-1][0] is None


def test_request(spark):
    one = lambda k, n: spark.range(1).select(A.request(F.lit("D"), F.lit("C"), F.lit("text"), F.lit(k), F.lit(n)).alias("r")).first().r
    assert "whole chapter" in one(1, 1) and "part 1 of 3" in one(1, 3) and "summary" not in one(2, 3) and "summary" in one(3, 3)
