"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafmill.llm import common

#: Words of a window and words from one window to the next.
WINDOW, STRIDE = 32, 24
#: The bound of the training sample: labelled rows of each class, and characters of a row.
TOXIC_ROWS, CLEAN_ROWS, ROW_CHARS = 1200, 2400, 2400
#: Known words at most, hash buckets of character n-grams and their lengths, size of an embedding, size of a state.
WORDS, BUCKETS, NGRAMS, EMBED, STATE = 20_000, 1 << 16, (3, 4, 5), 12, 8
EPOCHS, BATCH, RATE, SEED = 6, 96, 0.02, 11
#: Score from which a text is predicted toxic.
THRESHOLD = 0.3
#: Words a task remembers before it starts afresh, and windows scored together.
REMEMBER, TOGETHER = 60_000, 1024

TOKEN = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the hashed character n-grams of ``^word$``, word after word."""
    data = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    size = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(data)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))
    found, owner = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) ^ raw[at + k]
        h ^= h >> np.uint32(15)
        found.append((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        owner.append(word[at])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(data)))


def windows(n: int) -> list[tuple[int, int]]:
    """First word and end of each window of a text of ``n`` words; together they cover it."""
    starts = range(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return [(a, min(n, a + WINDOW)) for a in starts]


def _added(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Zeros of so many rows to which ``values`` are added at the rows ``at``: sorted and summed by runs."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        ranked = at[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        out[ranked[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Network:
    """Word and character inputs -> two gated recurrent layers -> attention -> one logit a window.

    A word's input is its own embedding (zero if unknown) beside the mean of those of its character
    n-grams; as it depends on the word alone, its product with the input weights is computed once a
    word. r = s(x Wr + h Ur), u = s(x Wu + h Uu), c = tanh(x Wc + r * h Uc), h' = u h + (1 - u) c.
    """

    def __init__(self, vocabulary: dict[str, int], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        scale = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "word": scale(len(vocabulary) + 1, EMBED, by=0.1), "char": scale(BUCKETS, EMBED, by=0.2),
            "W": scale(2, 2 * EMBED, 3 * STATE, by=0.3), "b": np.zeros((2, 1, 3 * STATE), np.float32), "U": scale(2, STATE, 3 * STATE, by=0.3),
            "att": scale(2 * STATE, by=0.3), "out": scale(2 * STATE, by=0.5), "bias": np.full(1, -2, np.float32),
        }
        self.p["word"][0] = 0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(known word or 0, n-gram buckets, their starts, inputs) of distinct words."""
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams, starts = ngrams(words)
        count = np.diff(np.append(starts, len(grams)))[:, None]
        char = np.add.reduceat(self.p["char"][grams], starts, axis=0) / count
        return known, grams, starts, np.concatenate((self.p["word"][known], char.astype(np.float32)), axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(2, words, 3 * STATE): what the words give to the gates of both directions."""
        return np.matmul(x[None], self.p["W"]) + self.p["b"]

    def forward(self, table: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window; ``at``: rows of ``table`` (2, words, gates), -1 past the window's end."""
        n, steps = at.shape
        both = np.stack((at, at[:, ::-1]))  # the second direction reads from the end
        h = np.zeros((2, n, STATE), np.float32)
        states = np.empty((2, steps, n, STATE), np.float32)
        for t in range(steps):
            x = np.stack((table[0][both[0, :, t]], table[1][both[1, :, t]]))
            real = (both[:, :, t] >= 0)[:, :, None]
            g = np.matmul(h, self.p["U"])
            ru = x[..., : 2 * STATE] + g[..., : 2 * STATE]
            np.negative(ru, out=ru)
            np.exp(np.minimum(ru, 60, out=ru), out=ru)
            ru += 1
            np.reciprocal(ru, out=ru)
            r, u = ru[..., :STATE], ru[..., STATE:]
            gc = g[..., 2 * STATE :]
            c = np.tanh(x[..., 2 * STATE :] + r * gc)
            new = np.where(real, c + u * (h - c), h)
            if keep is not None:
                keep.append((h, r, u, gc, c, real))
            states[:, t] = h = new
        hidden = np.concatenate((states[0], states[1, ::-1]), axis=2)  # steps, n, 2 * STATE
        e = hidden @ self.p["att"]
        e[at.T < 0] = -1e9
        e -= e.max(0)
        a = np.exp(e)
        a /= a.sum(0)
        pooled = np.einsum("tn,tnk->nk", a, hidden)
        if keep is not None:
            keep.append((hidden, a, pooled, both))
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, x: tuple, at: np.ndarray, keep: list, dz: np.ndarray) -> dict[str, np.ndarray]:
        known, grams, starts, inputs = x
        hidden, a, pooled, both = keep[-1]
        p, d = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        d["bias"][0], d["out"][:] = dz.sum(), dz @ pooled
        dpooled = dz[:, None] * p["out"]
        da = np.einsum("nk,tnk->tn", dpooled, hidden)
        de = a * (da - (a * da).sum(0))
        d["att"][:] = np.einsum("tn,tnk->k", de, hidden)
        dhidden = a[..., None] * dpooled + de[..., None] * p["att"]
        dstates = np.stack((dhidden[..., :STATE], dhidden[::-1, :, STATE:]))
        dh = np.zeros_like(dstates[:, 0])
        steps: list = [None] * at.shape[1]
        for t in range(at.shape[1] - 1, -1, -1):
            h, r, u, gc, c, real = keep[t]
            total = dh + dstates[:, t]
            live = np.where(real, total, 0)
            dc = live * (1 - u) * (1 - c * c)
            du = live * (h - c) * u * (1 - u)
            dr = dc * gc * r * (1 - r)
            dx = np.concatenate((dr, du, dc), axis=2)
            dg = np.concatenate((dr, du, dc * r), axis=2)
            d["U"] += np.matmul(h.transpose(0, 2, 1), dg)
            dh = np.where(real, live * u, total) + np.matmul(dg, p["U"].transpose(0, 2, 1))
            steps[t] = dx  # past the end it is 0
        dxs = np.stack(steps, axis=2).reshape(2, -1, 3 * STATE)
        dtable = np.stack([_added(len(known), both[k].reshape(-1), dxs[k]) for k in (0, 1)])
        d["W"][:] = np.matmul(inputs.T[None], dtable)
        d["b"][:] = dtable.sum(1, keepdims=True)
        dinputs = np.matmul(dtable, p["W"].transpose(0, 2, 1)).sum(0)
        d["word"] = _added(len(p["word"]), known, dinputs[:, :EMBED])
        d["word"][0] = 0
        count = np.diff(np.append(starts, len(grams)))
        d["char"] = _added(len(p["char"]), grams, np.repeat(dinputs[:, EMBED:] / count[:, None], count, axis=0))
        return d


def train(rows: list[tuple[str | None, int]], weight: float = 1.0, epochs: int = EPOCHS, seed: int = SEED) -> Network | float:
    """A network from (text, toxic) rows, or the share of toxic rows where a class is missing.

    A text is toxic if any of its windows is: with p the windows' probabilities the likelihood of a
    toxic text is 1 - prod(1 - p), that of a clean one prod(1 - p). ``weight`` counts a clean row so
    many times. Rows, order and start are fixed by the sample and the seed, so reruns agree.
    """
    docs = [(words_of(t), int(y)) for t, y in rows]
    docs = [x for x in docs if x[0]]
    if len({y for _, y in docs}) < 2:
        return float(np.mean([y for _, y in docs])) if docs else 0.0
    seen = Counter(w for ws, _ in docs for w in set(ws))
    known = sorted((w for w, n in seen.items() if n > 1), key=lambda w: (-seen[w], w))[:WORDS]
    net = Network({w: k for k, w in enumerate(known, 1)}, seed)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    steps, per_epoch = 0, -(-len(docs) // BATCH)
    epochs = max(epochs, -(-120 // per_epoch))  # few rows are seen more often
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(docs)), per_epoch):
            index: dict[str, int] = {}
            at, owner = [], []
            for k, i in enumerate(part):
                ids = [index.setdefault(w, len(index)) for w in docs[i][0]]
                for a, b in windows(len(ids)):
                    at.append(ids[a:b] + [-1] * (WINDOW - b + a))
                    owner.append(k)
            y = np.array([docs[i][1] for i in part], np.float32)
            at, owner = np.array(at), np.array(owner)
            x = net.inputs(list(index))
            keep: list = []
            z = net.forward(net.projected(x[3]), at, keep)
            prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(prob, 1 - 1e-6)), len(part)))
            pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-4), weight)
            dz = (pull[owner] * prob / len(part)).astype(np.float32)
            d = net.gradient(x, at, keep, dz)
            steps += 1
            rate = RATE * min(1.0, 2 * (1 - steps / (epochs * per_epoch + 1))) * np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps)
            for k, g in d.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores whole texts: the largest probability of all their overlapping windows."""

    def __init__(self, net: Network | float):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((2, 0, 3 * STATE), np.float32)
        self.used = 0

    def _ids(self, texts: list[list[str]]) -> list[list[int]]:
        if len(self.index) > REMEMBER:
            self.clear()
        new = [w for w in dict.fromkeys(w for ws in texts for w in ws) if w not in self.index]
        for low in range(0, len(new), 4_000):
            part = new[low : low + 4_000]
            rows = self.net.projected(self.net.inputs(part)[3])
            need = self.used + len(part)
            if need > self.table.shape[1]:
                grown = np.empty((2, max(need, 2 * self.table.shape[1]), 3 * STATE), np.float32)
                grown[:, : self.used] = self.table[:, : self.used]
                self.table = grown
            self.table[:, self.used : need] = rows
            self.index.update(zip(part, range(self.used, need), strict=True))
            self.used = need
        return [[self.index[w] for w in ws] for ws in texts]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not isinstance(self.net, Network):
            return [self.net] * len(texts)
        out = [0.0] * len(texts)
        todo, held, size = [], [], 0
        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            todo.append(words)
            held.append(k)
            size += len(words)
            if size > TOGETHER * STRIDE:
                self._score(held, todo, out)
                todo, held, size = [], [], 0
        if todo:
            self._score(held, todo, out)
        return out

    def _score(self, held: list[int], texts: list[list[str]], out: list[float]) -> None:
        ids = self._ids(texts)
        flat = np.concatenate([np.array(x, np.int64) for x in ids])
        base, starts, ends, owner = 0, [], [], []
        for k, x in enumerate(ids):
            for a, b in windows(len(x)):
                starts.append(base + a)
                ends.append(base + b)
                owner.append(k)
            base += len(x)
        starts, ends, owner = np.array(starts), np.array(ends), np.array(owner)
        best = np.full(len(ids), -np.inf, np.float32)
        for low in range(0, len(starts), TOGETHER):
            s, e = starts[low : low + TOGETHER, None], ends[low : low + TOGETHER, None]
            at = s + np.arange(WINDOW)
            at = np.where(at < e, flat[np.minimum(at, len(flat) - 1)], -1)
            np.maximum.at(best, owner[low : low + TOGETHER], self.net.forward(self.table, at))
        for k, z in zip(held, (1 / (1 + np.exp(-best.astype(float)))).tolist(), strict=True):
            out[k] = z


def held_out(id_col: str = "doc_id") -> Column:
    """Rows of which no label is learned: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list, float]:
    """Training rows (text, toxic) and the weight of a clean one.

    Of the labelled documents that are not held out and have at most ``ROW_CHARS`` characters, those
    with the lowest hashes of id: at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean ones.
    """
    wanted = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    short = docs.where(F.length(text_col) <= ROW_CHARS).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = short.select("id").join(wanted, F.col("id") == F.col("__id")).select("id", "y", F.xxhash64("id").alias("h"))
    sizes = {r.y: r["count"] for r in wanted.groupBy("y").count().collect()}
    picked = []  # ids first: what each task sends of its lowest hashes must not hold texts
    for y, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        picked += [(r.id, y) for r in known.where(F.col("y") == y).select("h", "id").distinct().orderBy("h", "id").limit(most).collect()]
    rows: list = []
    if picked:
        chosen = docs.sparkSession.createDataFrame(picked, f"__id {short.schema['id'].dataType.simpleString()}, y int")
        found = short.join(F.broadcast(chosen), F.col("id") == F.col("__id")).groupBy("id", "y").agg(F.min("text").alias("text")).collect()
        rows = [(r.text, r.y) for r in sorted(found, key=lambda r: (-r.y, str(r.id)))]
    toxic = sum(y for _, y in rows)
    clean = len(rows) - toxic
    weight = 1.0 if not toxic or not clean else (sizes[0] / sizes[1]) / (clean / toxic)
    return rows, float(min(4.0, max(1.0, weight)))


def scored(docs: DataFrame, net: Network | float, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``score_col``, which they must not have yet; texts without words (null and empty ones too) score 0."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net)  # of fixed size, some megabytes
    where = docs.columns.index(text_col)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in rows:
            scores: list[float] = []
            for low in range(0, batch.num_rows, 200):  # so many texts are copied at a time
                scores += scorer.scores(batch.column(where).slice(low, 200).to_pylist())
            common.give_back()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def trained(docs: DataFrame, labels: DataFrame) -> Network | float:
    rows, weight = sample(docs, labels)
    return train(rows, weight)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
