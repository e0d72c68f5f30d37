"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of pieces, where no other is named.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What a character without a piece costs below the worst piece.
UNKNOWN = 10.0
#: Trie nodes and remembered words a task holds before it starts afresh, and the longest pre-token that enters the trie.
MAX_NODES, MAX_WORDS, MAX_STORED = 500_000, 1_000_000, 64
SPACE = "▁"
MISSING = object()


def read_pieces(data: bytes) -> dict[str, float]:
    """{piece: log-probability} of the ordinary pieces of a serialized piece model.

    Field 1 of the message is a piece: 1 its text, 2 its score (float), 3 its type (1, ordinary, if absent). Field 2
    says how the model was made: 3 its kind (1, unigram, if absent). A unigram model's scores are log-probabilities
    and stay as they are. Those of any other kind only rank the pieces (minus the number of the merge), which no
    sum of scores may be made of; see :func:`zipf`.
    """

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = raw[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(raw):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                length = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, raw[at : at + length]
                at += length

    out: dict[str, float] = {}
    kind = 1
    for field, value in fields(data):
        if field == 2:
            kind = dict(fields(value)).get(3, 1)
        if field == 1:
            piece = dict(fields(value))
            if piece.get(3, 1) == 1:
                out[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
    return out if kind == 1 else zipf(out)


def zipf(ranked: dict[str, float]) -> dict[str, float]:
    """Log-probabilities of pieces of which only an order is known, the best score first: by Zipf's law, 1 / rank over their sum."""
    order = sorted(ranked, key=ranked.get, reverse=True)  # stable: equal scores keep the file's order
    total = math.log(sum(1 / k for k in range(1, len(order) + 1)))
    return {piece: -math.log(k) - total for k, piece in enumerate(order, 1)}


class Words(dict):
    """{word: tokens} of the words met so far, without their space mark; a missing one is counted."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.make = count

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = self[word] = self.make(SPACE + word)
        return found


class Counter:
    """Counts tokens of pre-tokens: the number of pieces in the segmentation of highest score.

    Pre-tokens are inserted in a trie. A node stands for a prefix and holds its forward score (the
    best score of any segmentation of the prefix) and the tokens of that segmentation, so a prefix
    that many pre-tokens share is scored once; a terminal node has the count of its pre-token. Of
    equal scores the one with fewer tokens counts. A character that no piece covers counts as many
    tokens as it has UTF-8 bytes.
    """

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.pieces: dict[str, float | None] = {}  # beside the pieces their beginnings, without a score
        for piece in pieces:
            for end in range(1, len(piece)):
                self.pieces.setdefault(piece[:end])
        self.pieces |= pieces
        self.words = Words(self.count)
        self.prune()

    def prune(self) -> None:
        """Drop the nodes; the terminal counts of words stay."""
        self.children: dict[tuple[int, str], int] = {}
        #: Of each node the score and count of its prefix, and the starts from which a piece may still go on.
        self.forward: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())]

    def _step(self, text: str, end: int, path: list[tuple[float, int, tuple[int, ...]]]) -> tuple[float, int, tuple[int, ...]]:
        """The node of text[:end]; path has those of all shorter prefixes."""
        begin = end - 1
        score, count, live = path[begin]
        best, most, fewest = score + self.unknown, 0, -1
        pieces, going = self.pieces, []
        for start in (*live, begin):
            worth = pieces.get(text[start:end], MISSING)
            if worth is not MISSING:
                going.append(start)
                if worth is not None:
                    before = path[start]
                    total, n = before[0] + worth, before[1] + 1
                    if total > best or total == best and (fewest < 0 or n < most):
                        best, most, fewest = total, n, start
        if fewest < 0:  # no piece ends here that is better than an unknown character
            most = count + len(text[begin].encode("utf-8", "surrogatepass"))
        return best, most, tuple(going)

    def count(self, word: str) -> int:
        """Tokens of one pre-token, of which the first character may be the space mark."""
        if len(self.forward) > MAX_NODES:
            self.prune()
        path = [self.forward[0]]
        if len(word) > MAX_STORED:  # scored by itself; it would fill the trie
            for end in range(1, len(word) + 1):
                path.append(self._step(word, end, path))
            return path[-1][1]
        node, children, forward = 0, self.children, self.forward
        for end, letter in enumerate(word, 1):
            key = (node, letter)
            node = children.get(key)
            if node is None:
                forward.append(self._step(word, end, path))
                node = children[key] = len(forward) - 1
            path.append(forward[node])
        return path[-1][1]

    def text(self, text: str | None) -> tuple[int, int]:
        """(tokens, pre-tokens) of a text; white space divides pre-tokens and is their space mark.

        Each distinct word goes through the trie once; its occurrences are looked up without any Python code of their own.
        """
        words = text.split() if text else []
        return sum(map(self.words.__getitem__, words)), len(words)


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, n_pretokens) for each row of ``docs``.

    A token is a piece of the segmentation of highest probability under the vocabulary as a unigram model; no
    tokenizer is trained. Null, empty and blank texts have 0 of both; repeated rows are returned as often as they occur.
    Other columns, whatever their names, are left out. No shuffle: each task counts its own rows, with a trie bounded in nodes. ``vocabulary`` is a path
    on the driver, else what the session's ``spark.leafmill.vocabulary`` says; the pieces (a file of fixed size) go to the tasks once, as a broadcast.
    """
    spark = docs.sparkSession
    path = vocabulary or spark.conf.get("spark.leafmill.vocabulary", VOCABULARY)
    pieces = spark.sparkContext.broadcast(read_pieces(Path(path).read_bytes()))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in rows:
            counts = [counter.text(t.as_py()) for t in batch.column(1)]
            tokens, words = (list(x) for x in zip(*counts, strict=True)) if counts else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], ["id", "n_tokens", "n_pretokens"])

    return source.mapInArrow(batches, f"id {id_type}, n_tokens long, n_pretokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every document."""
    return with_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
