"""Language of a text by its stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions.text import let

LETTERS = r"[\p{L}\p{N}&&[^\p{Nd}]]+"


def detect_language(text: Column, sample: int = 20_000) -> Column:
    """[A4, J13] The language most of whose stop words occur in the first ``sample`` characters.

    Ties go to the first language of the list; a text without stop words is English. Counting stays
    in the row: nine small sets, no shuffle.
    """
    found = F.regexp_extract_all(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, sample)), F.lit(LETTERS), 0)

    def best(words: Column) -> Column:
        scores = [
            F.struct(_count(words, stops).alias("n"), F.lit(-k).alias("order"), F.lit(lang).alias("lang"))
            for k, (lang, stops) in enumerate((lang, sorted(set(s.split()))) for lang, s in C.STOP_WORDS.items())
        ]
        return let(F.array_max(F.array(*scores)), lambda top: F.when(top["n"] > 0, top["lang"]).otherwise("en"))

    return let(found, best)


def _count(words: Column, stops: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*stops)))
