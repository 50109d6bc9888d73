"""Training of the linear text models of ``classify`` on all labelled rows, without texts on the driver.

Grams are counted in the tasks, and only the most frequent ones, a stated number, come to the driver. Rows then are sparse
vectors that are kept. Each round is one pass over these: the tasks add up the gradients of all models, which are of the size
of the vocabulary, and a tree of tasks adds up theirs. The models of all folds, and the one of all rows, go on side by side.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.reliable import checkpoint
from tracelake.operators.classify import char_places, joined, words_of

#: Characters of texts whose grams a task counts before it hands them on.
COUNTED = 1_000_000
#: Texts and vectors that are worked on at a time.
ROWS = 64


class Descent:
    """L-BFGS: asks for value and gradient at ``trial``, is told them, and goes on or takes half the step."""

    def __init__(self, n: int, memory: int = 10, tolerance: float = 1e-4):
        self.trial, self.x = np.zeros(n), np.zeros(n)
        self.value, self.gradient, self.way, self.step = math.inf, np.zeros(n), np.zeros(n), 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.memory, self.tolerance, self.least, self.done = memory, tolerance, 0.0, False

    def told(self, value: float, gradient: np.ndarray) -> None:
        if self.done:
            return
        first = not math.isfinite(self.value)
        if not first and value > self.value + 1e-4 * self.step * float(self.gradient @ self.way):
            self.step /= 2
            self.done = self.step < 1e-9
            self.trial = self.x + self.step * self.way
            return
        if first:
            self.least = self.tolerance * float(np.linalg.norm(gradient))
        elif float((s := self.trial - self.x) @ (y := gradient - self.gradient)) > 1e-12:
            self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.x, self.value, self.gradient = self.trial, value, gradient
        size = float(np.linalg.norm(gradient))
        self.done = size <= self.least
        way, kept = gradient.copy(), []
        for s, y in reversed(self.pairs):
            kept.append((a := float(s @ way) / float(s @ y)))
            way -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            way *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            way += (a - float(y @ way) / float(s @ y)) * s
        self.way, self.step = -way, 1.0 if self.pairs else 1 / max(1.0, size)
        self.trial = self.x + self.step * self.way


class Counts:
    """Of texts: in how many each gram is, and how often it comes in all."""

    def __init__(self, word: tuple[int, int], char: tuple[int, int]):
        self.word, self.char, self.docs, self.texts, self.size = word, char, Counter(), [], 0

    def add(self, text: str) -> None:
        self.docs.update(set(joined(words_of(text), *self.word)))
        self.texts.append(text)
        self.size += len(text)

    def __len__(self) -> int:
        return self.size

    def out(self) -> Iterator[pa.RecordBatch]:
        known, n = list(self.docs), pa.array(list(self.docs.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(["word"] * len(known), pa.string()), pa.array(known, pa.string()), n, n], ["part", "gram", "docs", "total"])
        grams, text, gram, often = char_places(self.texts, *self.char)
        total = np.zeros(len(grams), np.int64)
        np.add.at(total, gram, often)
        # Each gram once for each text that has it.
        both = np.sort(text * len(grams) + gram)
        once = both[np.diff(both, prepend=-1) > 0]
        docs = np.bincount(once % max(1, len(grams)), minlength=len(grams))
        yield pa.RecordBatch.from_arrays([pa.array(["char"] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(docs, pa.int64()), pa.array(total)], ["part", "gram", "docs", "total"])


def vocabulary(rows: DataFrame, n: int, *, word: tuple[int, int], char: tuple[int, int], grams: tuple[int, int], least_docs: int, most_docs: float) -> dict[str, dict]:
    """Of ``rows`` (``text``) the parts of a model without weights: at most ``grams`` of words and of characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(word, char)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.add(text)
                if len(counts) > COUNTED:
                    yield from counts.out()
                    counts = Counts(word, char)
        yield from counts.out()

    counted = rows.mapInArrow(count, "part string, gram string, docs long, total long").groupBy("part", "gram").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
    counted = checkpoint(counted.where((F.col("docs") >= least_docs) & (F.col("docs") <= most_docs * n)))
    parts = {}
    for part, most, ngrams, binary in (("word", grams[0], word, True), ("char", grams[1], char, False)):
        known = sorted((r.gram, r.docs) for r in counted.where(F.col("part") == part).orderBy(F.desc("total"), "gram").limit(most).collect())  # a stated number
        parts[part] = {"vocabulary": {g: i for i, (g, _) in enumerate(known)}, "idf": [math.log((1 + n) / (1 + d)) + 1 for _, d in known], "weights": [0.0] * len(known), "ngram_range": list(ngrams), "binary": binary, "sublinear_tf": True}
    return parts


def _vectors(parts: dict[str, dict], word: tuple[int, int], char: tuple[int, int]):
    """``y, fold, indices, values``: the rows that ``classify.part_score`` multiplies with the weights, and a constant; as bytes,
    which each round reads again without a step for each number."""
    cut_at = len(parts["word"]["vocabulary"])
    last = cut_at + len(parts["char"]["vocabulary"])

    def scaled(tf: np.ndarray) -> np.ndarray:
        return tf / np.sqrt(tf @ tf) if len(tf) else tf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = parts["word"]["vocabulary"], {k: np.array(p["idf"], float) for k, p in parts.items()}
        for batch in batches:
            indices, values = [], []
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), ROWS):
                own = texts[lo : lo + ROWS]
                _, text, gram, often = char_places(own, *char, known=parts["char"]["vocabulary"])
                counts = np.bincount(text * (last - cut_at) + gram, often, len(own) * (last - cut_at)).reshape(len(own), last - cut_at)
                for x, n in zip(own, counts):
                    # Words are binary, so a gram counts once.
                    at = np.array([i for g in dict.fromkeys(joined(words_of(x), *word)) if (i := known.get(g)) is not None], np.int32)
                    there = np.flatnonzero(n)
                    indices.append(np.concatenate([at, there + cut_at, [last]]).astype(np.int32).tobytes())
                    values.append(np.concatenate([scaled(idf["word"][at]), scaled(np.log(1 + n[there]) * idf["char"][there]), [1.0]]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array(indices, pa.binary()), pa.array(values, pa.binary())], ["y", "fold", "indices", "values"])

    return run


class Block(NamedTuple):
    """Some vectors: y (a column for each label), fold, where each begins, and all their places and values one after another."""

    y: np.ndarray
    fold: np.ndarray
    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """A column for each model. No vector is empty, as each has the constant."""
        return np.stack([np.add.reduceat(w[self.indices] * self.values, self.starts) for w in weights], axis=1)

    def weighed(self, by: np.ndarray, width: int) -> np.ndarray:
        """For each column of ``by`` the sum of the vectors times their numbers in it."""
        sizes = np.diff(np.r_[self.starts, len(self.indices)])
        return np.stack([np.bincount(self.indices, np.repeat(b, sizes) * self.values, width) for b in by.T])


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """A batch of vectors, some rows at a time."""
    if not batch.num_rows:
        return
    fold = batch.column("fold").to_numpy()
    y = batch.column("y").flatten().to_numpy().reshape(len(fold), -1)
    indices, values = batch.column("indices").to_pylist(), batch.column("values").to_pylist()
    for lo in range(0, len(fold), ROWS):
        own = slice(lo, lo + ROWS)
        starts = np.cumsum([0, *map(len, indices[own])])[:-1] // 4
        yield Block(y[own], fold[own], starts, np.frombuffer(b"".join(indices[own]), np.int32), np.frombuffer(b"".join(values[own]), np.float32).astype(float))


def _sums(shared, of_class: list[tuple[int, int, float, float]]):
    """A row for each task: of each model (its label, the fold that it leaves out, weights of its classes) the loss and its gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        label, without, less, more = (np.array(x) for x in zip(*of_class))
        out = np.zeros((len(weights), weights.shape[1] + 1))
        for batch in batches:
            for block in _blocks(batch):
                y = block.y[:, label]
                own = np.where(block.fold[:, None] == without, 0.0, np.where(y > 0, more, less))
                missed = np.maximum(0, 1 - y * block.margins(weights))
                out[:, 0] += (own * missed * missed).sum(axis=0)
                out[:, 1:] += block.weighed(-2 * own * y * missed, weights.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return run


def train_all(rows: DataFrame, text: str, label: str, classes: tuple[str, str], **settings) -> dict:
    """A model as ``classify.train`` makes it, of all rows that have a text and one of the two labels; settings as for ``train_each``."""
    return train_each(rows, text, [label], classes, **settings)[0]


def train_each(rows: DataFrame, text: str, labels: list[str], classes: tuple[str, str], *, group: str | None = None, word: tuple[int, int] = (1, 2), char: tuple[int, int] = (3, 5), grams: tuple[int, int] = (3000, 2000), least_docs: int = 2, most_docs: float = 0.95, c: float = 1.0, folds: int = 0, rounds: int = 60) -> list[dict]:
    """A model for each of ``labels``, of the rows that have a text and one of the two classes in every label. Grams are counted
    and texts made vectors once for all, and each round's pass serves all models.

    With ``folds`` (two or more), "accuracy" is that on rows whose fold a model hasn't learned from; rows that are equal in
    ``group`` (the text, if none is named) share a fold, so that variants of a row don't tell on it. Without rows all is zero.
    """
    spark = rows.sparkSession
    fold = F.pmod(F.xxhash64(group or text), F.lit(max(1, folds))).cast("int") if folds else F.lit(-1)
    d = rows.where(F.col(text).isNotNull())
    for x in labels:
        d = d.where(F.col(x).isin(*classes))
    # Without folds no row has the number of a model.
    d = checkpoint(d.select(F.col(text).alias("text"), F.array(*[F.when(F.col(x) == classes[1], 1.0).otherwise(-1.0) for x in labels]).alias("y"), fold.alias("fold")))
    sizes = d.groupBy("fold").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.get("y", F.lit(i)) > 0) for i in range(len(labels))]).alias("more")).collect()  # a row a fold
    n = sum(r.n for r in sizes)
    parts = vocabulary(d.select("text"), n, word=word, char=char, grams=grams, least_docs=least_docs, most_docs=most_docs)
    cut_at = len(parts["word"]["vocabulary"])
    width = cut_at + len(parts["char"]["vocabulary"]) + 1
    models = [{"classes": list(classes), **{k: dict(p) for k, p in parts.items()}, "bias": 0.0} for _ in labels]
    if not n:
        return models
    vectors = checkpoint(d.mapInArrow(_vectors(parts, word, char), "y array<double>, fold int, indices binary, values binary"))
    # Of each label, models 0 to folds - 1 leave out the fold of their number, the last one (-2) none.
    of_class = []
    for i in range(len(labels)):
        for k in [*range(folds), -2]:
            own, more = (sum(x for r, x in zip(sizes, of) if r.fold != k) for of in ([r.n for r in sizes], [r.more[i] for r in sizes]))
            of_class.append((i, k, c * own / 2 / max(1, own - more), c * own / 2 / max(1, more)))
    found = [Descent(width) for _ in of_class]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(np.stack([m.trial for m in found]))
        tasks = vectors.mapInArrow(_sums(shared, of_class), "sums binary").rdd.map(lambda r: np.frombuffer(r.sums))
        total = tasks.treeReduce(np.add, 2).reshape(len(found), width + 1)
        shared.destroy()
        for m, x in zip(found, total):
            m.told(float(x[0] + m.trial @ m.trial / 2), x[1:] + m.trial)
        if all(m.done for m in found):
            break
    for i, model in enumerate(models):
        w = found[i * (folds + 1) + folds].x
        model["word"]["weights"], model["char"]["weights"], model["bias"] = w[:cut_at].tolist(), w[cut_at:-1].tolist(), float(w[-1])
    if folds:
        weights = np.stack([m.x for m in found])

        def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = np.arange(len(labels)) * (folds + 1)
            for batch in batches:
                hit = np.zeros(len(labels), np.int64)
                for block in _blocks(batch):
                    hit += ((np.take_along_axis(block.margins(weights), first + block.fold[:, None], axis=1) >= 0) == (block.y > 0)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(labels)), pa.int64()), pa.array(hit)], ["label", "n"])

        hits = {r.label: r.n for r in vectors.mapInArrow(right, "label long, n long").groupBy("label").agg(F.sum("n").alias("n")).collect()}
        for i, model in enumerate(models):
            model["accuracy"] = hits[i] / n
    return models
