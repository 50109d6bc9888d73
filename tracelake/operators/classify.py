"""Labels for actions: heuristics as columns, linear text models as an Arrow UDF, backfill, and measures of labels."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.reliable import checkpoint

# Patterns that tell where an action is, in any case of letters.
EXTERNAL_PATTERNS = [
    r"https?://",
    r"web_?search",
    r"web_?fetch",
    r"npm\s+install",
    r"pip\s+install",
    r"cargo\s+install",
    r"git\s+push",
    r"git\s+clone",
    r"curl\s+",
    r"wget\s+",
    r"gh\s+(pr|issue|api)",
    r"docker\s+(pull|push)",
]
INTERNAL_PATTERNS = [
    r"cargo\s+(build|test|check|clippy|run)",
    r"git\s+(add|commit|diff|status|log)",
    r"src/",
    r"tests/",
    r"\.rs\b",
    r"\.py\b",
    r"\.toml\b",
]
# Patterns of routine work, in any case of letters, and of new ground, as they are.
ROUTINE_PATTERNS = [
    r"^cargo\s+(build|test|check|clippy|run)\b",
    r"^git\s+(add|commit|push|diff|status|log)\b",
    r"^ls\b",
    r"^cat\b",
    r"^mkdir\b",
    r"^rm\b",
    r"^cp\b",
    r"^mv\b",
    r"^echo\b",
    r"^npm\s+(run|test|build)\b",
    r"^python3?\s+-m\s+pytest",
]
NOVEL_PATTERNS = [
    r"error|Error|ERROR",
    r"failed|Failed|FAILED",
    r"traceback",
    r"panic",
    r"warning.*unused",
    r"investigate|debug|diagnose",
    r"why\s+(does|is|did|doesn)",
    r"how\s+to",
    r"search.*for",
]
# Patterns of friction, in any case of letters.
FRICTION_PATTERNS = [
    r"error\[",
    r"Error:",
    r"FAILED",
    r"failed",
    r"panic",
    r"traceback",
    r"warning\[",
    r"could not compile",
    r"cannot find",
    r"no such file",
    r"permission denied",
    r"timed? ?out",
    r"connection refused",
    r"exit code [1-9]",
    r"exit status [1-9]",
]
EXTERNAL, INTERNAL, ROUTINE, FRICTION = ("(?i)" + "|".join(p) for p in (EXTERNAL_PATTERNS, INTERNAL_PATTERNS, ROUTINE_PATTERNS, FRICTION_PATTERNS))
NOVEL = "|".join(NOVEL_PATTERNS)


def locus(obs_type: Column, content: Column, path: Column) -> Column:
    out, inside = content.rlike(EXTERNAL), content.rlike(INTERNAL)
    return (
        F.when(obs_type.isin("web_fetch", "web_search", "github", "mcp_call", "git_push"), "external")
        .when(obs_type.isin("file_read", "file_edit", "file_write", "search", "git_commit"), "internal")
        .when(out & ~inside, "external")
        .when(inside & ~out, "internal")
        .when(path.isNotNull() & (path != ""), "internal")
    )


def novelty(obs_type: Column, content: Column, path: Column) -> Column:
    short = F.substring(content, 1, 200)
    return (
        F.when(obs_type.isin("web_search", "web_fetch"), "novel")
        .when((obs_type == "command") & short.rlike(ROUTINE), "routine")
        .when((obs_type == "command") & (F.char_length(content) > 300), "novel")
        .when(obs_type.isin("git_commit", "git_push"), "routine")
        .when(short.rlike(NOVEL), "novel")
        .when(obs_type.isin("file_read", "file_edit", "file_write") & path.isNotNull() & (path != ""), "routine")
    )


def friction(obs_type: Column, content: Column, failed: Column) -> Column:
    return (
        F.when(failed, "friction")
        .when(obs_type.isin("git_commit", "git_push"), "smooth")
        .when(F.substring(content, 1, 500).rlike(FRICTION), "friction")
        .when(obs_type.isin("file_edit", "file_write", "file_read"), "smooth")
        .when((obs_type == "command") & ~content.rlike(FRICTION), "smooth")
    )


# --- linear models over word and character n-grams ---

#: Words whose grams a task keeps while it scores, each of LONG characters at most.
KEPT, LONG = 100_000, 32


def words_of(text: str) -> list[str]:
    """Words, A-Z in lower case."""
    return re.findall(r"\w+", text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def joined(words: list[str], lo: int, hi: int) -> Iterator[str]:
    """All runs of ``lo`` to ``hi`` words, the short ones first."""
    return chain.from_iterable(words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)))) for n in range(lo, hi + 1))


def word_grams(text: str, lo: int, hi: int) -> Counter:
    return Counter(joined(words_of(text), lo, hi))


@lru_cache(1024)
def _slices(size: int, lo: int, hi: int) -> Callable[[str], tuple[str, ...]]:
    at = [slice(i, i + n) for n in range(lo, hi + 1) for i in range(size - n + 1)]
    return itemgetter(*at) if len(at) > 1 else lambda w: tuple(w[x] for x in at)


def cut(word: str, lo: int, hi: int) -> tuple[str, ...]:
    """The n-grams of a word with a space on both sides, repeats included."""
    w = f" {word} "
    if len(word) <= LONG:
        return _slices(len(w), lo, hi)(w)
    return tuple(w[i : i + n] for n in range(lo, hi + 1) for i in range(len(w) - n + 1))


_cut = lru_cache(16384)(cut)


def char_grams(text: str, lo: int, hi: int) -> Counter:
    """Within words, each with a space on both sides. A word that comes again is cut once."""
    out: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        for g in _cut(w, lo, hi) if len(w) <= LONG else cut(w, lo, hi):  # long ones aren't kept
            out[g] = out.get(g, 0) + n
    return out


def part_score(part: dict, counts: Counter) -> float:
    """Dot product of weights with the tf-idf of known grams, scaled to length one."""
    v, known = {}, part["vocabulary"]
    for g, c in counts.items():
        if (i := known.get(g)) is not None:
            tf = 1.0 if part["binary"] else math.log(1 + c) if part["sublinear_tf"] else float(c)
            v[i] = tf * part["idf"][i]
    norm = math.sqrt(sum(x * x for x in v.values()))
    return sum(x / norm * part["weights"][i] for i, x in v.items()) if norm else 0.0


def _decided(model: dict, z: float) -> tuple[str, float]:
    p = 1 / (1 + math.exp(-z))
    return (model["classes"][1], p) if p >= 0.5 else (model["classes"][0], 1 - p)


def predict(model: dict, text: str) -> tuple[str, float]:
    """The class and how sure: the second class from a half on."""
    # A part that knows no grams needs none counted.
    word, char = (part_score(model[k], grams(text, *model[k]["ngram_range"])) if model[k]["vocabulary"] else 0.0 for k, grams in (("word", word_grams), ("char", char_grams)))
    return _decided(model, word + char + model["bias"])


def fingerprint(model: dict) -> str:
    return hashlib.sha256(json.dumps(model, sort_keys=True).encode()).hexdigest()[:16]


class Words:
    """Numbers of the known character grams of words: a word is cut once, whichever texts it comes in."""

    def __init__(self, lo: int, hi: int, known: dict[str, int]):
        self.range, self.known, self.of = (lo, hi), known, {}

    def numbers(self, words: Iterable[str]) -> list[np.ndarray]:
        """For each word those of its grams that are known, repeats included."""
        out = []
        for w in words:
            if (own := self.of.get(w)) is None:
                own = np.array([i for i in map(self.known.get, cut(w, *self.range)) if i is not None], np.int32)
                if len(w) <= LONG:
                    self.of[w] = own
            out.append(own)
        return out


def _cut_all(words: list[str], lo: int, hi: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams that ``cut`` gives for any of the words, and side by side the word and the gram of each place."""
    whole = "\n".join(f" {w} " for w in words)  # no word holds a line's end
    chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(chars == 10)
    there = np.zeros(int(chars.max(initial=0)) + 1, np.int64)
    there[chars] = 1
    digit, base = (np.cumsum(there) - 1)[chars], int(there.sum())
    code, range_, grams, of, at = digit, base, [], [], []
    for n in range(1, min(hi, len(chars)) + 1):
        if n > 1:
            if range_ * base >= 1 << 63:
                known, code = np.unique(code, return_inverse=True)
                range_ = len(known)
            code, range_ = code[:-1] * base + digit[n - 1 :], range_ * base
        if n >= lo:
            own = np.flatnonzero((word[: len(code)] == word[n - 1 :]) & (chars[: len(code)] != 10))
            _, first, number = np.unique(code[own], return_index=True, return_inverse=True)
            of.append(word[own])
            at.append(number + len(grams))
            grams += [whole[i : i + n] for i in own[first].tolist()]
    none = np.zeros(0, np.int64)
    return grams, np.concatenate([none, *of]), np.concatenate([none, *at])


def char_places(texts: list[str], lo: int, hi: int, known: dict[str, int] | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """``char_grams`` of many texts, each distinct word cut once: the distinct grams, and side by side text, gram and how often, a row
    for each gram of each distinct word of a text. With ``known``, only grams in it, by its numbers."""
    counts = [Counter(t.lower().split()) for t in texts]
    ids: defaultdict[str, int] = defaultdict()
    ids.default_factory = ids.__len__  # a word not seen before gets the next number
    word = np.fromiter(chain.from_iterable(map(ids.__getitem__, c) for c in counts), np.int64)
    often = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64)
    text = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
    grams, of, gram = _cut_all(list(ids), lo, hi)
    if known is not None:
        gram = np.array([known.get(g, -1) for g in grams], np.int64)[gram]
        of, gram = of[gram >= 0], gram[gram >= 0]
    gram = gram[np.argsort(of, kind="stable")]
    sizes = np.bincount(of, minlength=len(ids))
    begin, n = (np.cumsum(sizes) - sizes)[word], sizes[word]
    place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return grams, np.repeat(text, n), gram[place], np.repeat(often, n)


class Scorer:
    """What ``predict`` gives, for many texts: only grams that the model knows are counted, and a word that comes again is cut once."""

    def __init__(self, model: dict):
        self.model, self.words = model, Words(*model["char"]["ngram_range"], known=model["char"]["vocabulary"])
        self.of = {k: (np.array(model[k]["idf"], float), np.array(model[k]["weights"], float)) for k in ("word", "char")}

    def _part(self, name: str, at: np.ndarray, times: np.ndarray | None = None) -> float:
        part, (idf, weights) = self.model[name], self.of[name]
        if not len(at):
            return 0.0
        n = np.bincount(at, times, len(idf))
        known = np.flatnonzero(n)
        tf = np.ones(len(known)) if part["binary"] else np.log(1 + n[known]) if part["sublinear_tf"] else n[known]
        v = tf * idf[known]
        norm = math.sqrt(v @ v)
        return float(v @ weights[known]) / norm if norm else 0.0

    def __call__(self, text: str) -> tuple[str, float]:
        z, known = self.model["bias"], self.model["word"]["vocabulary"]
        if known:
            z += self._part("word", np.array([i for g in joined(words_of(text), *self.model["word"]["ngram_range"]) if (i := known.get(g)) is not None], np.int64))
        if self.model["char"]["vocabulary"] and (own := Counter(text.lower().split())):
            found = self.words.numbers(own)
            z += self._part("char", np.concatenate(found), np.repeat(np.fromiter(own.values(), np.int64, len(found)), [len(x) for x in found]))
            if len(self.words.of) > KEPT:
                self.words.of.clear()
        return _decided(self.model, z)


def classifier(spark, models: dict[str, dict]):
    """An Arrow UDF: a text's label and confidence in each dimension. The models are broadcast once."""
    shared = spark.sparkContext.broadcast(models)
    kind = T.StructType([f for d in models for f in (T.StructField(d, T.StringType()), T.StructField(f"{d}_confidence", T.DoubleType()))])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorers = {d: Scorer(m) for d, m in shared.value.items()}
        for texts in batches:
            out = {}
            for d, score in scorers.items():
                found = [score(x or "") for x in texts]
                out[d], out[f"{d}_confidence"] = [a for a, _ in found], [b for _, b in found]
            yield pd.DataFrame(out)

    return run


def _fitted(counts: list[Counter], *, ngram_range: tuple[int, int], binary: bool, most: int, least_docs: int, most_docs: float) -> dict:
    """A part of a model without weights: the most frequent grams that are in ``least_docs`` texts and a share of ``most_docs`` at most."""
    docs, total = Counter(), Counter()
    for c in counts:
        docs.update(c.keys())
        total.update(dict.fromkeys(c, 1) if binary else c)
    known = sorted((g for g, n in docs.items() if least_docs <= n <= most_docs * len(counts)), key=lambda g: (-total[g], g))[:most]
    return {"vocabulary": {g: i for i, g in enumerate(sorted(known))}, "idf": [math.log((1 + len(counts)) / (1 + docs[g])) + 1 for g in sorted(known)], "weights": [0.0] * len(known), "ngram_range": list(ngram_range), "binary": binary, "sublinear_tf": True}


def _matrix(part: dict, counts: list[Counter]) -> np.ndarray:
    """The rows that ``part_score`` multiplies with the weights."""
    out = np.zeros((len(counts), len(part["vocabulary"])), np.float32)
    for row, c in zip(out, counts):
        for g, n in c.items():
            if (i := part["vocabulary"].get(g)) is not None:
                row[i] = (1.0 if part["binary"] else math.log(1 + n)) * part["idf"][i]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _separated(x: np.ndarray, y: np.ndarray, c: float, steps: int) -> np.ndarray:
    """Weights, the last one of a constant: half their square and ``c`` times the squared margins that are missed, classes of equal
    weight, at its least (accelerated gradient steps)."""
    x, y = np.hstack([x, np.ones((len(x), 1), np.float32)]), y.astype(np.float32)
    weight = np.where(y > 0, len(y) / 2 / max(1, (y > 0).sum()), len(y) / 2 / max(1, (y < 0).sum())).astype(np.float32) * np.float32(c)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) or np.float32(1)
    rate = np.float32(1 / (1 + 2 * float(v @ (x.T @ (weight * (x @ v))))))
    w, ahead, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1.0
    for _ in range(steps):
        missed = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * (x.T @ (weight * y * missed)))
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + np.float32((was - 1) / t) * (new - w)
    return w


def train(rows: DataFrame, text: str, label: str, classes: tuple[str, str], *, most: int = 2000, word: tuple[int, int] = (1, 2), char: tuple[int, int] = (3, 5), grams: tuple[int, int] = (3000, 2000), least_docs: int = 2, most_docs: float = 0.95, c: float = 1.0, folds: int = 0, steps: int = 300) -> dict:
    """A linear model of words and of characters, its margin as wide as may be, on a bounded sample of ``most`` labelled rows.

    The sample, which comes to the driver, is of the least hashes of text and label. With ``folds``, "accuracy" is that on
    parts which the model, trained on the others, hasn't seen; parts have classes in equal shares.
    """
    d = rows.where(F.col(label).isin(*classes) & F.col(text).isNotNull()).orderBy(F.xxhash64(text, label)).limit(most).select(text, label).collect()
    y = np.array([1.0 if r[1] == classes[1] else -1.0 for r in d])
    counted = {"word": [word_grams(r[0], *word) for r in d], "char": [char_grams(r[0], *char) for r in d]}
    kinds = {"word": {"ngram_range": word, "binary": True, "most": grams[0]}, "char": {"ngram_range": char, "binary": False, "most": grams[1]}}

    def fit(own: np.ndarray) -> dict:
        parts = {k: _fitted([counted[k][i] for i in own], least_docs=least_docs, most_docs=most_docs, **kinds[k]) for k in counted}
        w = _separated(np.hstack([_matrix(parts[k], [counted[k][i] for i in own]) for k in counted]), y[own], c, steps)
        cut = len(parts["word"]["vocabulary"])
        parts["word"]["weights"], parts["char"]["weights"] = w[:cut].tolist(), w[cut:-1].tolist()
        return {"classes": list(classes), **parts, "bias": float(w[-1])}

    if not len(d):
        return {"classes": list(classes), **{k: _fitted([], least_docs=1, most_docs=1.0, **kinds[k]) for k in kinds}, "bias": 0.0}
    model = fit(np.arange(len(d)))
    if folds:
        part = np.zeros(len(d), int)
        for side in (1.0, -1.0):
            own = np.flatnonzero(y == side)
            part[own] = np.arange(len(own)) % folds
        right = 0
        for k in range(folds):
            if (part == k).any() and (part != k).any():
                other = fit(np.flatnonzero(part != k))
                right += sum(predict(other, d[i][0])[0] == d[i][1] for i in np.flatnonzero(part == k))
        model["accuracy"] = right / len(d)
    return model


def register_run(runs: DataFrame, name: str, model: dict, *, as_of: int) -> tuple[DataFrame, int]:
    """The registry ``id, name, model_hash, accuracy, created_at`` with a run of this name and model, and its id: the one that is
    there already, or a new one."""
    hashed = fingerprint(model)
    found = runs.where((F.col("name") == name) & (F.col("model_hash") == hashed)).select("id").first()
    if found is not None:
        return runs, found[0]
    number = (runs.agg(F.max("id")).first()[0] or 0) + 1
    row = runs.sparkSession.createDataFrame([(number, name, hashed, model.get("accuracy"), as_of)], "id long, name string, model_hash string, accuracy double, created_at long")
    return runs.unionByName(row), number


def backfill(obs: DataFrame, models: dict[str, dict], text: str = "content") -> DataFrame:
    """Fills missing labels of the models' dimensions; labels that are there stay."""
    run = classifier(obs.sparkSession, models)
    out = obs.withColumn("_m", run(F.col(text)))
    return out.withColumns({d: F.coalesce(F.col(d), F.col(f"_m.{d}")) for d in models}).drop("_m")


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of ``expected, predicted``."""
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def measures(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, and the accuracy of all. Pairs, which may be costly, are made once: their counts are kept."""
    c = checkpoint(confusion(pairs))
    whole = c.agg((F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    classes = c.select(F.col("expected").alias("class")).union(c.select("predicted")).distinct().where("class IS NOT NULL")
    hit = F.sum(F.when((F.col("expected") == F.col("class")) & (F.col("predicted") == F.col("class")), F.col("n")).otherwise(0))
    said, true = (F.sum(F.when(F.col(x) == F.col("class"), F.col("n")).otherwise(0)) for x in ("predicted", "expected"))
    m = classes.join(c, (F.col("class") == F.col("expected")) | (F.col("class") == F.col("predicted"))).groupBy("class").agg(hit.alias("tp"), said.alias("said"), true.alias("true"))
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.when(F.col("true") > 0, F.col("tp") / F.col("true")).otherwise(0.0)
    return m.crossJoin(F.broadcast(whole)).select("class", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


def label_counts(obs: DataFrame, column: str) -> DataFrame:
    return obs.groupBy(column).agg(F.count("*").alias("n"))


def balanced(rows: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest has, those of the least hash, in place of chance.

    A histogram of the hash tells in which of its 4,096 buckets a class has enough; only that bucket's rows are put in order.
    """
    hashed = rows.where(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns]))
    hashed = hashed.withColumn("_bucket", F.shiftright("_h", 52))
    along = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(along))
    least = counts.groupBy(label).agg(F.max("_upto").alias("_all")).agg(F.min("_all").alias("_least"))
    border = counts.crossJoin(F.broadcast(least)).where(F.col("_upto") >= F.col("_least")).groupBy(label).agg(F.min(F.struct("_bucket", (F.col("_least") - F.col("_upto") + F.col("_n")).alias("_rest"))).alias("_b"))
    found = hashed.join(border.select(label, F.col("_b._bucket").alias("_border"), "_b._rest"), label)
    within = found.where(F.col("_bucket") < F.col("_border"))
    last = found.where(F.col("_bucket") == F.col("_border")).withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy("_h"))).where("_rn <= _rest")
    return within.select(rows.columns).unionByName(last.select(rows.columns))


def sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows as if by chance, the same ones for the same seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns])).limit(n)


def summary_quality(summaries: DataFrame, column: str = "summary") -> DataFrame:
    """Whether a model's answer is JSON, which of the seven fields it has, how many are lists, and their sizes."""
    fields, lists = ("intent", "learned", "completed", "next_steps", "files_read", "files_edited", "notes"), ("learned", "completed", "next_steps", "files_read", "files_edited")
    keys, raw = F.json_object_keys(column), lambda f: F.coalesce(F.get_json_object(column, f"$.{f}"), F.lit(""))
    there = lambda f: F.coalesce(F.array_contains(keys, f), F.lit(False)).cast("int")
    count = lambda f: F.coalesce(F.json_array_length(raw(f)), F.lit(0)).cast("long")
    return summaries.select(
        "*",
        keys.isNotNull().alias("json_valid"),
        sum((there(f) for f in fields[1:]), there(fields[0])).alias("fields_present"),
        sum((F.json_array_length(raw(f)).isNotNull().cast("int") for f in lists[1:]), F.json_array_length(raw(lists[0])).isNotNull().cast("int")).alias("array_compliance"),
        F.size(F.array_remove(F.split(raw("intent"), r"\s+"), "")).alias("intent_words"),
        *[count(f).alias(f"{f}_count") for f in lists],
        (raw("notes") != "").alias("notes_present"),
    )


def variant_averages(quality: DataFrame, variant: str) -> DataFrame:
    """By variant of a prompt or model: answers, those that are JSON or have notes, and averages of the other measures of ``summary_quality``."""
    mean = ("fields_present", "array_compliance", "intent_words", "learned_count", "completed_count", "next_steps_count")
    return quality.groupBy(variant).agg(F.count("*").alias("n"), F.count_if("json_valid").alias("json_valid"), F.count_if("notes_present").alias("notes_present"), *[F.round(F.avg(x), 6).alias(f"avg_{x}") for x in mean])
